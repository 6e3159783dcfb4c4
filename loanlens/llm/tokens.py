"""Token counts and ids with a public tokenizer file, in Arrow tasks.

Texts are cut at ASCII spaces and line feeds, where this kind of vocabulary
(white space dropped, one piece per word, digit or punctuation run) never has
a token across. Each distinct chunk is encoded once per worker by the library
and its ids are kept in a bounded memo, so a batch becomes array lookups; texts of any length are handled in segments of bounded size. Chunks that
are letters followed by plain punctuation are encoded as these two parts, many
per library call; everything else goes to the library as it stands, so special
strings, digits, marks and other white space get the library's treatment.

Null and empty texts have no tokens. Repeated rows give repeated results.
"""

from __future__ import annotations

import os
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as W

PLAIN = ".,;:!?|#$%&*"
#: parts remembered per worker; the memo starts anew beyond it
MEMO = 250_000
#: parts to a library call
GROUP = 512


class _Table:
    """Open-addressing map from 64-bit hashes to numbers, filled and asked in
    whole arrays. It holds at most half its slots."""

    def __init__(self, slots: int):
        self.mask = np.uint64(slots - 1)
        self.keys = np.zeros(slots, np.uint64)
        self.values = np.zeros(slots, np.int32)
        self.used = 0

    def get(self, h: np.ndarray) -> np.ndarray:
        """Number of every hash, -1 where it is not held."""
        out = np.full(len(h), -1, np.int32)
        left, at = np.arange(len(h)), h & self.mask
        while len(left):
            k = self.keys[at]
            hit = k == h[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (k != 0)
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask
        return out

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """New, different hashes."""
        self.used += len(h)
        if 2 * self.used > len(self.keys):       # a batch of very many parts: a larger table
            old = self.keys != 0
            keys, numbers = self.keys[old], self.values[old]
            self.__init__(1 << (2 * self.used - 1).bit_length())
            self.put(np.concatenate((keys, h)), np.concatenate((numbers, values)))
            return
        left, at = np.arange(len(h)), h & self.mask
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[left[free]]         # the last of several wins
            won = free & (self.keys[at] == h[left])
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + np.uint64(1)) & self.mask


class Encoder:
    """Chunks are told apart by 64-bit hashes of their bytes, so the memo is a
    few flat arrays."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.is_end = np.array([t is not None and t.endswith("</w>")
                                for t in map(self.tok.id_to_token, range(size))])
        if not self.is_end.any():
            raise ValueError("this vocabulary does not mark word ends")
        self.sep = np.ones(256, bool)
        self.sep[[32, 10]] = False
        self.letter = np.zeros(256, bool)
        self.letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
        self.plain = np.zeros(256, bool)
        self.plain[[ord(c) for c in PLAIN]] = True
        self.low = W.lower_table()
        self.limit = memo
        self._clear()

    @classmethod
    def shared(cls, path: str) -> "Encoder":
        """One encoder per worker process and file, kept between tasks."""
        cache = sys.__dict__.setdefault("_loanlens_encoders", {})
        if path not in cache:
            cache[path] = cls(path)
        return cache[path]

    def _clear(self):
        self.table = _Table(1 << (2 * self.limit - 1).bit_length())
        self.pool = np.zeros(0, np.int32)
        # part 0 is empty; part 1 stands for letters that the library would not keep in one word
        self.start, self.size = np.zeros(2, np.int64), np.zeros(2, np.int64)

    def _library(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in
                self.tok.encode_batch_fast(strings, add_special_tokens=False)]

    def _add(self, hashes: np.ndarray, ids: list, sizes: np.ndarray) -> None:
        self.table.put(hashes, np.arange(len(self.size), len(self.size) + len(sizes), dtype=np.int32))
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.pool = np.concatenate((self.pool, *ids))

    def _letters(self, text: str) -> bool:
        """Whether the text is all letters, also once the library has normalised
        it: a capital whose lower case ends in a mark would give that mark to the
        punctuation after it."""
        if not text.isalpha():
            return False
        plain = text.isascii() or self.tok.normalizer is None
        return plain or self.tok.normalizer.normalize_str(text).isalpha()

    def _parts(self, data, starts, ends, words: bool) -> np.ndarray:
        """Part number of every byte range. ``words``: ranges of letters or of
        plain punctuation, encoded many per library call; else one by one."""
        h = W.hash_words(data, starts, ends)
        h = (h if words else W.mix(h)) | np.uint64(1)
        part = self.table.get(h)
        new = np.flatnonzero(part < 0)
        if not len(new):
            return part
        keys, first = np.unique(h[new], return_index=True)
        first = new[first]
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if words:
            good = np.array([t[0] in PLAIN or self._letters(t) for t in texts])
            self.table.put(keys[~good], np.ones(int((~good).sum()), np.int32))
            texts = [t for t, g in zip(texts, good) if g]
            keys = keys[good]
        ids, sizes = [], []
        for lo in range(0, len(texts), GROUP):
            group = texts[lo:lo + GROUP]
            if words:
                got = self._library([" ".join(group)])[0]
                last = np.flatnonzero(self.is_end[got])
                if len(last) == len(group) and last[-1] == len(got) - 1:
                    ids.append(got)
                    sizes.append(np.diff(last, prepend=-1))
                    continue
            got = self._library(group)
            ids += got
            sizes.append(np.array([len(x) for x in got], np.int64))
        if texts:
            self._add(keys, ids, np.concatenate(sizes))
        return self.table.get(h)

    def _chunks(self, texts):
        """(parts of every chunk as two columns, first chunk of every text)."""
        if self.table.used > self.limit:
            self._clear()
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        data, offsets = W.buffers(col)
        starts, ends, first = W.find_words(data, offsets, self.sep)
        part = np.zeros((len(starts), 2), np.int32)
        if not len(starts):
            return part, first
        letters = np.zeros(len(data) + 1, np.int32)
        np.cumsum(self.letter[data], out=letters[1:])
        plain = np.zeros(len(data) + 1, np.int32)
        np.cumsum(self.plain[data], out=plain[1:])
        n = letters[ends] - letters[starts]
        cut = starts + n
        simple = (n > 0) & (letters[cut] - letters[starts] == n) & (plain[ends] - plain[cut] == ends - cut)
        low = self.low[data]
        one = np.flatnonzero(simple)
        part[one, 0] = self._parts(low, starts[one], cut[one], True)
        two = one[cut[one] < ends[one]]
        part[two, 1] = self._parts(low, cut[two], ends[two], True)
        rest = np.flatnonzero(~simple | (part[:, 0] == 1))
        part[rest, 0] = self._parts(data, starts[rest], ends[rest], False)
        part[rest, 1] = 0
        return part, first

    def lengths(self, texts) -> np.ndarray:
        """Tokens of every text."""
        part, first = self._chunks(texts)
        total = np.zeros(len(part) + 1, np.int64)
        np.cumsum(self.size[part].sum(axis=1), out=total[1:])
        return total[first[1:]] - total[first[:-1]]

    def ids(self, texts):
        """(ids of all texts back to back, offsets)."""
        part, first = self._chunks(texts)
        size, start = self.size[part].ravel(), self.start[part].ravel()
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        where = np.repeat(start - total[:-1], size) + np.arange(total[-1])
        return self.pool[where], total[2 * first]


def segments(text: str, limit: int):
    """The text cut at spaces or line feeds into parts of about ``limit``
    characters (one longer run without either stays whole)."""
    lo, n = 0, len(text)
    while n - lo > limit:
        cut = max(text.rfind(" ", lo + 1, lo + limit), text.rfind("\n", lo + 1, lo + limit))
        if cut < 0:
            after = [c for c in (text.find(" ", lo + limit), text.find("\n", lo + limit)) if c >= 0]
            if not after:
                break
            cut = min(after)
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


def batches_of(table, limit: int = 1 << 20, column: str = "text"):
    """(rows, offsets in bytes, texts as an Arrow column) by slices of about ``limit`` bytes."""
    for rows, _, offsets in W.slices(table, limit, column):
        yield rows, offsets, rows.column(column)


def count_tokens(docs: DataFrame, path: str, max_tokens: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text", segment: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``; only
    lengths leave the tasks."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        enc = Encoder.shared(path)
        for b in batches:
            for rows, offsets, texts in batches_of(b, segment):
                if len(texts) == 1:
                    n = np.array([sum(int(enc.lengths([s])[0])
                                      for s in segments(texts[0].as_py() or "", segment))])
                else:
                    n = enc.lengths(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n),
                     pa.array(n > max_tokens)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)
