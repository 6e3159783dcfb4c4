"""Streaming scoring equals batch scoring with the same fitted artefacts."""
import numpy as np
import pytest

from loanlens import config as C
from loanlens.operators import ml as ML
from loanlens.plans import credit as CR
from loanlens.streaming import scoring as ST


def test_stream_scores_match_batch(spark, credit, tmp_path):
    unskewed = CR.build_features(credit, skew=False)
    skew_model = CR.fit_skew(unskewed)
    feats = skew_model.transform(unskewed)
    model = ML.train_classifier(feats, gbt_iter=3, ensemble=False)
    batch = {r.SK_ID_CURR: r.probability for r in ML.score(model, feats).collect()}

    src = str(tmp_path / "apps")
    app = credit["application_train"]
    app.filter("SK_ID_CURR < 100030").write.parquet(src + "/part1")     # two "uploads"
    app.filter("SK_ID_CURR >= 100030").write.parquet(src + "/part2")
    rollups = CR.child_rollups(credit)
    stream = ST.read_applications(spark, src + "/*", app.schema)
    scored = ST.score_applications(stream, rollups, model, skew_model)
    q = ST.start(scored, None, checkpoint=str(tmp_path / "ckpt"), fmt="memory", query_name="scores_t")
    q.awaitTermination(300)
    got = {r.SK_ID_CURR: r.probability for r in spark.sql("SELECT * FROM scores_t").collect()}
    assert set(got) == set(batch)
    np.testing.assert_allclose([got[k] for k in sorted(got)], [batch[k] for k in sorted(got)], rtol=1e-9)
