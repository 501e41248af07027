"""Category encoding, scoring, metrics and chained steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.operators import columns, encode, models, steps
from tableloom.plans import training
from tableloom.sinks.files import FileTarget, write_files
from tableloom.staging import new_path
from workload.registry import query, table

_TOP_BRANDS = """SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS place
                 FROM part GROUP BY p_brand QUALIFY place < 5"""


@query(
    f"""SELECT coalesce(t.p_brand, 'OTHER') AS brand, count(*) AS n
        FROM part p LEFT JOIN ({_TOP_BRANDS}) t ON p.p_brand = t.p_brand GROUP BY ALL"""
)
def topn_other(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_brand")
    brands = encode.fit_categories(parts, "p_brand", 5)
    return parts.groupBy(brands.capped().alias("brand")).agg(F.count(F.lit(1)).alias("n"))


_WORDS = "SELECT unnest(string_split(text, ' ')) AS word FROM documents"


@query(
    f"""WITH w AS ({_WORDS}), t AS (
           SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS place FROM w GROUP BY word QUALIFY place <= 50)
       SELECT coalesce(t.word, 'OTHER') AS word, count(*) AS n FROM w LEFT JOIN t USING (word) GROUP BY ALL"""
)
def topn_other_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 most frequent of very many words, and the rest."""
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    common = encode.fit_categories(words, "word", 50)
    return words.groupBy(common.capped().alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT p.p_partkey, p.p_brand, CAST(coalesce(t.place, 5) AS INTEGER) AS brand_index
        FROM part p LEFT JOIN ({_TOP_BRANDS}) t ON p.p_brand = t.p_brand"""
)
def freq_index(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    brands = encode.fit_categories(parts, "p_brand", 5)
    return parts.withColumn("brand_index", brands.index())


_TOP_TYPES = """SELECT kind, row_number() OVER (ORDER BY count(*) DESC, kind NULLS FIRST) - 1 AS place
                FROM (SELECT nullif(p_type, 'ECONOMY') AS kind FROM part) GROUP BY kind"""


@query(
    f"""SELECT p.p_partkey, CAST(t.place AS INTEGER) AS kind_index
        FROM part p JOIN ({_TOP_TYPES}) t ON nullif(p.p_type, 'ECONOMY') IS NOT DISTINCT FROM t.kind"""
)
def freq_index_with_null(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.nullif("p_type", F.lit("ECONOMY")).alias("kind"))
    kinds = encode.fit_categories(parts, "kind", 100)
    return parts.select("p_partkey", kinds.index().alias("kind_index"))


_SLOTS = ", ".join(
    [f"CAST(coalesce(t.place, 5) = {i} AS INTEGER) AS slot_{i}" for i in range(6)]
)


@query(f"SELECT p.p_partkey, {_SLOTS} FROM part p LEFT JOIN ({_TOP_BRANDS}) t ON p.p_brand = t.p_brand")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    brands = encode.fit_categories(parts, "p_brand", 5)
    # The slots are named after the values; the SQL cannot know them, so they are numbered here.
    hot = brands.with_one_hot(parts, ["p_partkey"])
    return hot.toDF("p_partkey", *[f"slot_{i}" for i in range(len(brands.slots()))])


@query(
    """WITH t AS (SELECT c_name AS name, row_number() OVER (ORDER BY count(*) DESC, c_name) AS place
                  FROM customer GROUP BY c_name)
       SELECT c_custkey, least(place, 501) AS slot FROM customer JOIN t ON c_name = name"""
)
def one_hot_wide(spark: SparkSession, sf: str) -> DataFrame:
    """500 slots and one for the rest, back to the number of the one that is set."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    names = encode.fit_categories(customers, "c_name", 500)
    hot = names.with_one_hot(customers, ["c_custkey"])
    return hot.select("c_custkey", F.array_position(F.array(*hot.columns[1:]), 1).alias("slot"))


@query(
    """WITH v AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'OTHER' WHEN c_nationkey % 2 = 0 THEN c_mktsegment
                              ELSE 'NATION ' || c_nationkey END AS x FROM customer),
            t AS (SELECT x, row_number() OVER (ORDER BY count(*) DESC, x) AS place FROM v GROUP BY x QUALIFY place <= 3)
       SELECT coalesce(t.x, CASE WHEN 'OTHER' IN (SELECT x FROM t) THEN 'OTHER_1' ELSE 'OTHER' END) AS segment, count(*) AS n
       FROM v LEFT JOIN t USING (x) GROUP BY ALL"""
)
def topn_other_clash(spark: SparkSession, sf: str) -> DataFrame:
    """A value that is called as the rest is keeps its name and its count."""
    kind = F.expr(
        """CASE WHEN c_mktsegment = 'BUILDING' THEN 'OTHER' WHEN c_nationkey % 2 = 0 THEN c_mktsegment
           ELSE concat('NATION ', c_nationkey) END"""
    )
    customers = table(spark, sf, "customer").select(kind.alias("x"))
    kinds = encode.fit_categories(customers, "x", 3)
    return customers.groupBy(kinds.capped().alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT p.p_partkey, {_SLOTS} FROM part p LEFT JOIN ({_TOP_BRANDS}) t ON p.p_brand = t.p_brand")
def one_hot_vector(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    brands = encode.fit_categories(parts, "p_brand", 5)
    indexed = parts.select("p_partkey", brands.index().cast("double").alias("brand_index"))
    vectors, _ = encode.one_hot_vector(indexed, ["brand_index"], ["brand_vec"])
    names = [f"slot_{i}" for i in range(len(brands.slots()))]
    slots = vectors.select("p_partkey", *encode.vector_columns("brand_vec", names))
    return slots.select("p_partkey", *[F.col(n).cast("int").alias(n) for n in names])


@query(
    """SELECT p_partkey, CAST(place AS DOUBLE) AS p_brand_idx FROM part JOIN (
         SELECT p_brand AS b, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS place
         FROM part GROUP BY p_brand) ON p_brand = b"""
)
def string_index(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    model = training.string_indexer(parts, ["p_brand"], "frequencyDesc")
    return model.transform(parts).drop("p_brand")


_SEGMENTS = "SELECT c_custkey, nullif(c_mktsegment, 'FURNITURE') AS segment, c_name AS name FROM customer"


@query(
    f"""SELECT c_custkey,
               CASE WHEN segment IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY segment NULLS LAST) - 1 END AS segment_code,
               dense_rank() OVER (ORDER BY name) - 1 AS name_code
        FROM ({_SEGMENTS})"""
)
def category_codes(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("segment"), F.col("c_name").alias("name")
    )
    coded = encode.category_codes(customers, ["segment", "name"])
    return coded.drop("segment", "name")


@query(
    """WITH scored AS (SELECT c_custkey, -1.5 + 0.0004 * c_acctbal + 0.05 * c_nationkey AS d FROM customer)
       SELECT c_custkey, round(d, 6) AS decision, round(1 / (1 + exp(-d)), 6) AS probability,
              round(-ln(1 + exp(-d)), 6) AS log_probability, CAST(d > 0 AS INTEGER) AS prediction FROM scored"""
)
def score_fixed_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    scored = customers.select("c_custkey", *[c.alias(n) for n, c in _scores().items()])
    rounded = ("decision", "probability", "log_probability")
    return scored.withColumns({c: F.round(c, 6) for c in rounded})


def _scores():
    return models.linear_score({"c_acctbal": 0.0004, "c_nationkey": 0.05}, -1.5)


@query(
    """SELECT CAST(-1.5 + 0.0004 * c_acctbal + 0.05 * c_nationkey > 0 AS INTEGER) AS Predictions, count(*) AS n
       FROM customer GROUP BY ALL"""
)
def predictions_csv(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_acctbal", "c_nationkey")
    path = new_path(spark, "predictions")
    write_files(customers.select(_scores()["prediction"].alias("Predictions")), FileTarget(path))
    written = spark.read.option("header", True).schema("Predictions int").csv(path)
    return written.groupBy("Predictions").agg(F.count(F.lit(1)).alias("n"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """True quality next to a simple rule on the length of the text."""
    documents = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    rule = (F.col("n_chars") > 400).cast("int").alias("predicted")
    return labels.join(documents, "doc_id").select("quality", rule)


_JUDGED = "SELECT quality AS y, CAST(n_chars > 400 AS INTEGER) AS p FROM labels JOIN documents USING (doc_id)"


@query(f"SELECT y AS label, p AS prediction, count(*) AS n FROM ({_JUDGED}) GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return models.confusion_matrix(_judged(spark, sf), "quality", "predicted")


_PER_CLASS = f"""j AS ({_JUDGED}), k AS (SELECT unnest([0, 1]) AS c),
  s AS (SELECT c, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y = c) AS actual,
               count(*) FILTER (p = c) AS predicted FROM j, k GROUP BY c),
  m AS (SELECT c, actual, tp / predicted AS pr, tp / actual AS re, 2 * tp / (actual + predicted) AS f FROM s),
  acc AS (SELECT avg(CAST(y = p AS INTEGER)) AS a FROM j)"""


def _metric_sql(average: str, precision: str, recall: str, f1: str, source: str) -> str:
    return f"""SELECT '{average}' AS average, 'accuracy_score' AS metric, round(a, 9) AS value FROM acc
      UNION ALL SELECT '{average}', 'precision_score', round({precision}, 9) FROM {source}
      UNION ALL SELECT '{average}', 'recall_score', round({recall}, 9) FROM {source}
      UNION ALL SELECT '{average}', 'f1_score', round({f1}, 9) FROM {source}"""


@query(
    f"WITH {_PER_CLASS} "
    + " UNION ALL ".join(
        [
            _metric_sql("binary", "pr", "re", "f", "m WHERE c = 1"),
            _metric_sql("micro", "a", "a", "a", "acc"),
            _metric_sql("macro", "avg(pr)", "avg(re)", "avg(f)", "m"),
            _metric_sql(
                "weighted",
                "sum(pr * actual) / sum(actual)",
                "sum(re * actual) / sum(actual)",
                "sum(f * actual) / sum(actual)",
                "m",
            ),
        ]
    )
)
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = models.classification_metrics(
        _judged(spark, sf), "quality", "predicted", averages=models.AVERAGES
    )
    return found.withColumn("value", F.round("value", 9))


@query()
def train_and_score(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the labelled documents, save, load, and score every document."""
    documents = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", (F.col("n_chars") / 1000).alias("kilo_chars")
    )
    labelled = documents.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    plan = training.TrainingPlan(
        features=["kilo_chars", "lang", "source"], label="quality", categories=["lang", "source"]
    )
    path = new_path(spark, "model")
    training.save(training.train(labelled, plan), path)
    scored = training.score(training.load(path), documents)
    return scored.select(
        "doc_id", F.col("prediction").cast("int").alias("prediction"), F.element_at("probabilities", 2).alias("probability")
    )


def _saturated(spark: SparkSession, sf: str) -> tuple[DataFrame, training.PipelineModel, int]:
    """Documents, and a model of quality by a category of two values, saved and loaded."""
    documents = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "en", "en").otherwise("other").alias("language"), F.col("n_chars")
    )
    labelled = documents.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    plan = training.TrainingPlan(
        features=["language"], label="quality", categories=["language"], model={"penalty": "none", "tol": 1e-10}
    )
    path = new_path(spark, "model")
    model, left_out = training.train_counted(labelled, plan)
    training.save(model, path)
    return documents, training.load(path), left_out


_MEANS = """SELECT CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS language, avg(quality) AS p
            FROM labels JOIN documents USING (doc_id) GROUP BY ALL"""


@query(
    f"""SELECT doc_id, language, round(p, 4) AS probability, round(ln(p / (1 - p)), 3) AS decision,
               CAST(p > 0.5 AS INTEGER) AS prediction
        FROM documents JOIN ({_MEANS}) m ON (lang = 'en') = (language = 'en')"""
)
def train_saturated(spark: SparkSession, sf: str) -> DataFrame:
    """Without a penalty and with a parameter per value, probabilities are the means of the values."""
    documents, model, _ = _saturated(spark, sf)
    scored = training.score(model, documents)
    return scored.select(
        "doc_id",
        "language",
        F.round(F.element_at("probabilities", 2), 4).alias("probability"),
        F.round(F.element_at("decisions", 2), 3).alias("decision"),
        F.col("prediction").cast("int").alias("prediction"),
    )


@query(
    f"""SELECT doc_id, language, round(p, 4) AS probability, round(ln(p / (1 - p)), 3) AS decision,
               CAST(p > 0.5 AS INTEGER) AS prediction
        FROM documents JOIN ({_MEANS}) m ON (lang = 'en') = (language = 'en')"""
)
def refit_saturated(spark: SparkSession, sf: str) -> DataFrame:
    """A model of half the labels, saved, then fitted on with all of them from its coefficients."""
    documents = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "en", "en").otherwise("other").alias("language")
    )
    labelled = documents.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    plan = training.TrainingPlan(
        features=["language"], label="quality", categories=["language"], model={"penalty": "none", "tol": 1e-9}
    )
    path = new_path(spark, "model")
    training.save(training.train(labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), plan), path)
    model, _ = training.refit(training.load(path), labelled, plan)
    return training.score(model, documents).select(
        "doc_id",
        "language",
        F.round(F.element_at("probabilities", 2), 4).alias("probability"),
        F.round(F.element_at("decisions", 2), 3).alias("decision"),
        F.col("prediction").cast("int").alias("prediction"),
    )


@query(
    f"""WITH m AS ({_MEANS}), o AS (SELECT ln(p / (1 - p)) AS d, language FROM m)
        SELECT 2 AS classes, round((SELECT d FROM o WHERE language = 'en'), 3) AS intercept,
               round((SELECT d FROM o WHERE language = 'other') - (SELECT d FROM o WHERE language = 'en'), 3) AS coefficient"""
)
def model_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes are 0 and 1, so the intercept and the coefficient are log odds."""
    _, model, _ = _saturated(spark, sf)
    found = models.attributes(model.stages[-1])
    line = [(len(found["classes"]), round(found["intercept"][0], 3), round(found["coefficients"][0][0], 3))]
    return spark.createDataFrame(line, "classes int, intercept double, coefficient double")


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN round(p, 4) END AS probability
        FROM documents JOIN ({_MEANS}) m ON (lang = 'en') = (language = 'en')"""
)
def score_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a feature stay, without a prediction."""
    documents = table(spark, sf, "documents").select("doc_id", (F.col("lang") == "en").cast("double").alias("english"))
    labelled = documents.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    plan = training.TrainingPlan(features=["english"], label="quality", model={"penalty": "none", "tol": 1e-10})
    gaps = documents.withColumn("english", F.when(F.col("doc_id") % 7 != 0, F.col("english")))
    scored = training.score(training.train(labelled, plan), gaps)
    return scored.select("doc_id", F.round(F.element_at("probabilities", 2), 4).alias("probability"))


@query(
    """SELECT o_custkey, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18, 2))) * 1.5, 2)::DOUBLE AS scaled
       FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey"""
)
def chained_steps(spark: SparkSession, sf: str) -> DataFrame:
    keep = steps.Step(columns.filter_eq, {"column": steps.REQUIRED, "value": steps.Variable("status")})

    def total(df: DataFrame, factor: str) -> DataFrame:
        price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")) * F.lit(factor).cast("decimal(4,2)")
        return df.groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("n"), F.round(price, 2).cast("double").alias("scaled")
        )

    chain = [keep.with_inputs(column="o_orderstatus"), steps.Step(total, {"factor": steps.Variable("factor")})]
    return steps.run_steps(table(spark, sf, "orders"), chain, {"status": "O", "factor": "1.5"})


@query(
    """SELECT event_id, CAST(nfc_normalize(event_type || chr(101) || chr(769)) = event_type || chr(233) AS BOOLEAN) AS composed
       FROM events"""
)
def row_function(spark: SparkSession, sf: str) -> DataFrame:
    """Unicode normalisation, which Spark has no function for."""
    events = table(spark, sf, "events").select("event_id", "event_type")

    def normalise(rows: pd.DataFrame) -> pd.DataFrame:
        whole = (rows["event_type"] + "e\u0301").str.normalize("NFC")
        return pd.DataFrame({"event_id": rows["event_id"], "composed": whole == rows["event_type"] + "\u00e9"})

    return steps.row_function(events, normalise, "event_id long, composed boolean")
