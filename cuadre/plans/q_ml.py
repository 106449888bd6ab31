"""ML family: label statistics and metrics on ``labels`` (quality as the label, toxic as a stand-in prediction), and
the line classifier trained on document lines labelled by their document's quality (M01-M08, K08, A30, X09, X11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuadre.functions import line_features as LF
from cuadre.operators import lines as L
from cuadre.operators import ml
from cuadre.plans.registry import query
from cuadre.sources.tables import table


def _labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"),
                                              F.col("toxic").alias("prediction"))


@query("label_distribution", ("A30",), oracle="""
  SELECT quality AS label, count(*) AS n,
         CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100.0 AS pct
  FROM labels GROUP BY quality""")
def q_label_distribution(spark, sf):
    return L.label_distribution(_labels(spark, sf), "label")


@query("confusion", ("M07",), oracle="""
  SELECT quality AS label, toxic AS prediction, count(*) AS n,
         CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY quality) AS DOUBLE) AS row_share
  FROM labels GROUP BY quality, toxic""")
def q_confusion(spark, sf):
    return ml.confusion(_labels(spark, sf))


@query("class_weights", ("M03",), oracle="""
  SELECT quality AS label, count(*) AS n_class,
         CAST(sum(count(*)) OVER () AS DOUBLE) / CAST(count(*) OVER () * count(*) AS DOUBLE) AS weight
  FROM labels GROUP BY quality""")
def q_class_weights(spark, sf):
    return ml.class_weights(_labels(spark, sf))


_PCM = """
  c AS (SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY ALL),
  cls AS (SELECT label AS cls FROM c UNION SELECT prediction FROM c),
  m AS (SELECT cls, COALESCE((SELECT sum(n) FROM c WHERE label = cls), 0) AS support,
               COALESCE((SELECT sum(n) FROM c WHERE prediction = cls), 0) AS predicted,
               COALESCE((SELECT sum(n) FROM c WHERE label = cls AND prediction = cls), 0) AS tp FROM cls),
  p AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall FROM m),
  f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall)
                       ELSE 0.0 END AS f1 FROM p)"""


@query("per_class_metrics", ("M06",), oracle=f"""
  WITH {_PCM}
  SELECT cls, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp,
         precision, recall, f1 FROM f""")
def q_per_class_metrics(spark, sf):
    return ml.per_class_metrics(_labels(spark, sf)).select("cls", "support", "predicted", "tp", "precision",
                                                           "recall", "f1")


@query("classification_metrics", ("M06", "M08"), oracle=f"""
  WITH {_PCM}
  SELECT (SELECT avg(CAST(quality = toxic AS DOUBLE)) FROM labels) AS accuracy,
         (SELECT count(*) FROM labels) AS n, avg(f1) AS macro_f1,
         avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy FROM f""")
def q_classification_metrics(spark, sf):
    return ml.evaluate(_labels(spark, sf))


@query("split_assignment", ("M02",))
def q_split_assignment(spark, sf):
    return ml.stratified_split(_labels(spark, sf), "doc_id").select("doc_id", "label", "split")


def quality_class():
    return F.when(F.col("quality") == 1, F.lit("GOOD")).otherwise(F.lit("POOR"))


def labelled_lines(spark, sf):
    """Lines of labelled documents with their 67 features and the document's class."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labs = table(spark, sf, "labels").select("doc_id", quality_class().alias("label"))
    lines = L.text_lines(docs.join(labs, "doc_id"), "doc_id", "text", keep=["label"])
    feats = L.line_features(lines, keep=["file", "line_no", "label"])
    return ml.stratified_split(feats.withColumnRenamed("file", "doc_id"), "doc_id")


def _train(spark, sf):
    data = labelled_lines(spark, sf)
    train = ml.with_weights(data.where(F.col("split") != "test"))
    return ml.fit_once(ml.build_pipeline(LF.FEATURE_NAMES, num_trees=20, max_depth=6), train), data


@query("predict_lines", ("M01", "M04", "M05", "P13", "X09", "X11"))
def q_predict_lines(spark, sf):
    model, data = _train(spark, sf)
    test = ml.align_features(data.where(F.col("split") == "test"), LF.FEATURE_NAMES,
                             keep=["doc_id", "line_no", "label"])
    return ml.predict(model, test, keep=["doc_id", "line_no", "label"]).drop("probabilities")


@query("feature_importance", ("K08",))
def q_feature_importance(spark, sf):
    model, _ = _train(spark, sf)
    return ml.feature_importance(model, LF.FEATURE_NAMES, top=25)
