"""The registered queries of this subpackage, each applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableloom.llm import chat, html, lm, mixing, packing, phrases, pii, quality, runs, sharding, simhash, topk, wavelet
from tableloom.llm.text import text_of
from tableloom.llm.tokens import default_vocabulary
from tableloom.staging import new_path, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PROBE = "</s>[INST] ok [/INST]"
_CONTROL_SQL = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|\|endoftext\|>)"


@query(
    rf"""WITH turns AS (
           SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}'),
         shown AS (
           SELECT *, regexp_replace(text, '{_CONTROL_SQL}', '\1\\\2\3', 'g') AS body,
                  replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B') AS head
           FROM turns)
         SELECT conv_id, count(*) AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                sum(length(head) + length(body) + length('<|im_start|><|im_end|>') + 2)::BIGINT AS formatted_chars
         FROM shown GROUP BY conv_id"""
)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and -7, formatted and read back. Repeated turns stay separate turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', :probe), (-7L, 1L, 'assistant', :probe) AS t(conv_id, turn, role, text)",
        {"probe": _PROBE},
    )
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    events = rows.unionByName(probe).select(
        F.col("conv_id").alias("conversation"),
        place.alias("message"),
        place.alias("seq"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )
    back = chat.read_back(chat.render(chat.fold_events(events)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    losses = F.array_join("loss_texts", "")
    return back.select(
        F.col("conversation").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(losses).cast("long").alias("loss_chars"),
        F.sha2(losses, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2 048 tokens, one row per piece."""
    pieces = stage(packing.token_pieces(table(spark, sf_dir, "documents"), default_vocabulary()), "pieces")
    return packing.pack(pieces)


@query(
    """WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings),
         scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
                    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
         SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
         FROM scores QUALIFY rank <= 10"""
)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best candidates of every hundredth vector, by integer inner product."""
    vectors = topk.usable_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 100 == 0), 10)


@query()
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances from the language references and verdict for every document."""
    return quality.quality(table(spark, sf_dir, "documents"), carry=["doc_id"])


@query()
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query()
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it; copies of a row are listed each."""
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    each = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        F.col("key").alias("doc_id"),
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        (F.col("size") * (F.col("repetitions") + (F.col("copy") <= F.col("extra")).cast("long"))).cast("long").alias("taken"),
    )


@query()
def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the written shards."""
    path = new_path(spark, "tokens")
    wavelet.write_tokens(table(spark, sf_dir, "documents"), path, default_vocabulary())
    return wavelet.read_documents(wavelet.open_shards(spark, path)).withColumnRenamed("key", "doc_id")


def _count_of(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


@query()
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole text."""
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text")))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))
    counts = [_count_of(kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.withColumnRenamed("spans", "found").select(
        "doc_id",
        *counts,
        F.sha2(pii.joined_spans(base), 256).alias("base_sha256"),
        pii.joined_spans(F.col("found")).alias("spans"),
    )


@query()
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of every text; nine tenths of the documents train the model."""
    scores, _ = lm.score(table(spark, sf_dir, "documents"))
    return scores.withColumnRenamed("key", "doc_id")


# Small enough for the test tables to split at several depths; SHARD_BYTES is the limit of real shards.
_OP10_BYTES = 64 << 10


@query(
    f"""WITH cells AS (
           SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::INT AS cell
           FROM documents),
         depths AS (SELECT cells.*, d::INT AS depth, cell >> (16 - d)::INT AS bucket FROM cells, range(17) r(d)),
         fits AS (
           SELECT depth, bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM depths
           GROUP BY ALL HAVING sum(n_bytes) <= {_OP10_BYTES} OR count(*) = 1)
         SELECT doc_id, n_bytes, '/' || lpad(bin(bucket), depth, '0') AS shard, depth, shard_bytes, shard_rows
         FROM depths JOIN fits USING (depth, bucket)
         QUALIFY depth = min(depth) OVER (PARTITION BY cell)"""
)
def op10_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document at 64 KB a shard, with the shard's depth, bytes and rows."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    return sharding.extendible_shards(docs, "doc_id", F.col("n_bytes"), _OP10_BYTES)


@query()
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, whether markup settled it, and the words that its site repeats."""
    return html.main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_markup", "n_repeated"
    )


@query(
    rf"""WITH texts AS (
           SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
         pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
         words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
         totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
         places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) r(k)),
         f AS (
           SELECT lang, k, w[i : i + k - 1] AS g, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
         cuts AS (
           SELECT c.lang, c.g, c.k, c.f AS a, x.cut, h.f AS l, t.f AS r, n::BIGINT AS n,
                  ((1000::HUGEINT * c.f * n::HUGEINT) // (h.f::HUGEINT * t.f))::BIGINT AS score
           FROM f c JOIN range(1, 5) x(cut) ON x.cut < c.k
           JOIN f h ON h.lang = c.lang AND h.g = c.g[1 : x.cut]
           JOIN f t ON t.lang = c.lang AND t.g = c.g[x.cut + 1 : c.k]
           JOIN totals ON totals.lang = c.lang
           QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, x.cut) = 1),
         inside AS (
           SELECT DISTINCT s.lang, s.g FROM cuts s JOIN f b ON b.lang = s.lang AND b.k > s.k AND 100 * b.f >= 100 * s.a
           WHERE list_contains([b.g[i : i + s.k - 1] FOR i IN range(1, b.k - s.k + 2)], s.g))
         SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
                a, l, r, n, score, cut::INT AS cut
         FROM (SELECT *, array_to_string(g, ' ') AS phrase FROM cuts ANTI JOIN inside USING (lang, g))
         QUALIFY rank <= {phrases.TOP}"""
)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2 000 strongest phrases of two to five words."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, its longest one, and a digest of the words that stay."""
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=runs.with_loops)
    return found.withColumn("collapsed_sha256", F.sha2("text", 256)).drop("text")
