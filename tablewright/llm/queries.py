"""One query per operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewright.llm.ann_forest import nearest_vectors
from tablewright.llm.binary_packing import pack_by_powers
from tablewright.llm.chat_events import DELETE, DELTA, EDIT, MESSAGE, REGENERATE, fold_events, read_back, render
from tablewright.llm.language_cnn import fit_language_model, predict_languages
from tablewright.llm.minhash import near_duplicates
from tablewright.llm.poisson_mix import poisson_mix, with_positions
from tablewright.llm.quality_cnn import fit_quality_model, score_quality
from tablewright.llm.secret_layers import find_secrets
from tablewright.llm.spaced_seeds import benchmark_overlaps
from tablewright.llm.spelling_variants import count_words, variant_groups
from tablewright.llm.splitters import range_shards
from tablewright.llm.token_records import read_records, write_records
from tablewright.llm.word_runs import word_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Target shares of bytes by source; all other sources share the rest.
MIX_WEIGHTS, MIX_REST = {"src0": 0.10, "src1": 0.10, "src2": 0.02, "src3": 0.05}, 0.73


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_class(buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``: the fold that says which rows a model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % buckets


@query()
def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth vector."""
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


_CHAT_SQL = r"""
    WITH given AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    escaped AS (
      SELECT *, regexp_replace(replace(role, '\', '\\'), '<(\|(turn|text|end)\|>)', '<\\\1', 'g') AS role_out,
        regexp_replace(replace(text, '\', '\\'), '<(\|(turn|text|end)\|>)', '<\\\1', 'g') AS text_out FROM given)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(8 + length(role_out) + 8 + length(text_out) + 7) AS BIGINT) AS formatted_chars
    FROM escaped GROUP BY conv_id
"""


@query(_CHAT_SQL)
def op2_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a log of streamed messages, folded, rendered, and read back from the rendered text."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    extra = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (CAST(0 AS BIGINT), 'user'), (CAST(1 AS BIGINT), 'assistant') AS t(turn, role)"
    )
    # Turns may repeat a number, so messages are named by their place.
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = given.unionByName(extra).withColumn("message", place)
    half = F.floor(F.length("text") / 2).cast("int")
    rest = F.substring("text", half + 1, F.length("text"))
    begin = F.substring("text", F.lit(1), half)

    def event(step: int, kind: str, text: Column) -> Column:
        return F.struct((8 * F.col("message") + step).alias("seq"), F.lit(kind).alias("kind"), "role", text.alias("text"))

    # Every turn has a first draft that is edited while it streams, and a generation that is thrown away. What counts
    # is the last new beginning and what streams in after it. Every seventh turn is followed by one that is deleted.
    log = F.array(
        event(0, MESSAGE, F.lit("draft ")), event(1, DELTA, F.reverse(begin)), event(2, EDIT, F.concat(F.lit("edited "), rest)),
        event(3, REGENERATE, F.lit("discarded ")), event(4, DELTA, F.lit("<|end|>")), event(5, REGENERATE, begin), event(6, DELTA, rest),
    )
    events = rows.select("conv_id", "message", F.inline(log))
    gone = rows.where("message % 7 = 0").select(
        "conv_id", (-F.col("message")).alias("message"),
        F.inline(F.array(event(7, MESSAGE, F.lit("unsent")), event(9, DELETE, F.lit("")))),
    )
    events = events.unionByName(gone)
    read = read_back(render(fold_events(events)))
    listed = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write record files, and read them back."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_records(documents, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_records(manifest).drop("ids")


@query()
def op4_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and kept flag of each document; links at 0.85 over five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document by a network that learned from the rows outside the held-out third."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(id_class(3) != 1)
    model = fit_quality_model(documents, labels)
    scored = score_quality(documents, model)
    return scored.select("doc_id", (id_class(3) == 1).alias("held_out"), "score", "predicted")


@query()
def op6_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64("text").alias("h"),
    )
    shards = range_shards(rows, F.col("h"), F.col("doc_id"), F.col("size"), shards=16)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query()
def op7_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document, plain and in decoded layers."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = F.filter("findings", lambda s: s["depth"] == 0)
    counts = [_count_of(F.col("plain"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.withColumn("plain", plain).select(
        "doc_id", *counts, F.sha2(_listed(F.col("plain")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("findings")).alias("spans"),
        (F.size("findings") - F.size("plain")).cast("long").alias("n_decoded"), F.col("n_closed").cast("long").alias("n_closed"),
    )


@query()
def op8_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by a network that learned from the rows outside the held-out quarter."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(documents.where(id_class(4) != 2))
    return predict_languages(documents, model).select("doc_id", (id_class(4) == 2).alias("held_out"), "lang_pred", "score")


_WEIGHTS_SQL = " ".join(f"WHEN '{name}' THEN {weight}" for name, weight in MIX_WEIGHTS.items())
_KNOWN_SQL = ", ".join(f"'{name}'" for name in MIX_WEIGHTS)


@query(
    f"""
    WITH sized AS (
      SELECT doc_id, source, CASE WHEN source IN ({_KNOWN_SQL}) THEN source ELSE '' END AS pool,
        coalesce(strlen(text), 0) + 1 AS size FROM documents),
    pools AS (SELECT pool, sum(size) AS bytes, CASE pool {_WEIGHTS_SQL} ELSE {MIX_REST} END AS weight FROM sized GROUP BY pool),
    rates AS (SELECT pool, CAST(weight AS DOUBLE) / (SELECT sum(CAST(weight AS DOUBLE)) FROM pools)
      * (SELECT sum(bytes) FROM pools) / bytes AS mean FROM pools),
    cumulative AS (SELECT pool, j, sum(exp(j * ln(mean) - mean - lgamma(j + 1))) OVER (PARTITION BY pool ORDER BY j) AS upto
      FROM rates, (SELECT CAST(range AS DOUBLE) AS j FROM range(0, 64))),
    drawn AS (SELECT doc_id, source, pool,
      CAST('0x' || substr(md5('copies 7:0:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM sized),
    counted AS (SELECT doc_id, source, (SELECT count(*) FROM cumulative c WHERE c.pool = d.pool AND c.upto <= d.u) AS copies
      FROM drawn d),
    spread AS (SELECT doc_id, source, CAST(unnest(range(0, copies)) AS INTEGER) AS copy FROM counted)
    SELECT doc_id, source, copy, md5('shuffle 7:' || doc_id || ':' || copy) AS shuffle_key,
      row_number() OVER (ORDER BY md5('shuffle 7:' || doc_id || ':' || copy)) - 1 AS position FROM spread
    """
)
def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents by which sources reach their target share, and their place in the shuffled mix."""
    mix = poisson_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), MIX_WEIGHTS, MIX_REST, seed=7)
    return with_positions(mix.drop("text"))


# Brute force for leaks: two of 13 words may differ, so four words in a row agree; all windows on that diagonal are compared.
_LEAKS_SQL = r"""
    WITH docs AS (
      SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    words AS (
      SELECT min(item_id) AS item_id, w FROM (
        SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
        FROM benchmark) WHERE len(w) >= 1 GROUP BY w),
    items AS (SELECT * FROM words WHERE len(w) >= 13),
    short AS (
      SELECT doc_id, item_id, p, len(i.w) AS n FROM (
        SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM docs WHERE len(w) >= 5) d
      JOIN (SELECT * FROM words WHERE len(w) BETWEEN 5 AND 12) i ON d.w[p + 1 : p + 5] = i.w[1:5] AND d.w[p + 1 : p + len(i.w)] = i.w
      UNION ALL SELECT doc_id, item_id, 0, len(i.w) FROM docs d JOIN words i ON d.w = i.w WHERE len(i.w) < 5),
    doc_grams AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 4], ' ') AS g FROM (
      SELECT doc_id, w, unnest(range(0, len(w) - 3)) AS p FROM docs WHERE len(w) >= 13)),
    item_grams AS (SELECT item_id, p, array_to_string(w[p + 1 : p + 4], ' ') AS g FROM (
      SELECT item_id, w, unnest(range(0, len(w) - 3)) AS p FROM items)),
    diagonals AS (SELECT DISTINCT doc_id, item_id, d.p - i.p AS shift FROM doc_grams d JOIN item_grams i USING (g)),
    windows AS (
      SELECT doc_id, item_id, d.w AS dw, i.w AS iw, shift,
        unnest(range(greatest(0, shift), least(len(d.w), len(i.w) + shift) - 12)) AS s
      FROM diagonals JOIN docs d USING (doc_id) JOIN items i USING (item_id)),
    compared AS (
      SELECT doc_id, item_id, s,
        list_sum(list_transform(range(0, 13), lambda j: CAST(dw[s + j + 1] = iw[s + j - shift + 1] AS INTEGER))) AS same FROM windows)
    SELECT doc_id, item_id, CAST(min(s) AS INTEGER) AS first_word, CAST(max(s) + 13 AS INTEGER) AS end_word,
      CAST(max(same) AS INTEGER) AS same_words
    FROM compared WHERE same >= 11 GROUP BY doc_id, item_id
    UNION ALL SELECT doc_id, item_id, CAST(min(p) AS INTEGER), CAST(max(p + n) AS INTEGER), CAST(max(n) AS INTEGER)
    FROM short GROUP BY doc_id, item_id
"""


@query(_LEAKS_SQL)
def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark."""
    return benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Brute force for variants: words that agree without one code point. crc32 bit by bit: a byte is followed by eight steps.
_VARIANTS_SQL = r"""
    WITH RECURSIVE
    runs AS (
      SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
    own AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS x FROM runs GROUP BY doc_id, w),
    bytes AS (SELECT w, n, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)) AS b FROM own),
    crcs AS (
      SELECT w, n, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(b, lambda y: [y, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, y: CASE WHEN y >= 0 THEN xor(c, y) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h FROM bytes),
    slipped AS (
      SELECT n, CASE WHEN h IS NOT NULL AND h % 97 = 0
        THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM crcs),
    words AS (
      SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    cut AS (
      SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
      FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
    pairs AS (
      SELECT a.word, a.n AS own, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
      UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near
      FROM pairs),
    forms AS (
      SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN r.near END AS form,
        CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
      FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
    way AS (
      SELECT word, word AS at FROM forms
      UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON forms.word = way.at WHERE forms.form IS NOT NULL)
    SELECT f.word, f.form, way.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
    FROM forms f JOIN way ON way.word = f.word JOIN forms e ON e.word = way.at AND e.form IS NULL
"""


@query(_VARIANTS_SQL)
def op11_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form and the root of every frequent word of all documents, with planted slips."""
    return variant_groups(count_words(table(spark, sf_dir, "documents"), slips=97))


def _with_repeats(text: Column) -> Column:
    """Texts of every tenth id (by its crc32) go on, from a word that depends on it, by repeating some of their words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        whole = F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n.cast("int"))
        return F.array_join(whole, " ")

    # An array of one array: its words are taken apart once, not once for each use.
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


@query()
def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic stretches of words of each document, and the document without their repetitions."""
    documents = table(spark, sf_dir, "documents").select("doc_id", _with_repeats(F.coalesce("text", F.lit(""))).alias("text"))
    run = "struct<start: bigint, length: bigint, period: bigint>"
    longer = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", F.lit(None).cast(run), lambda best, r: F.when(best.isNull() | longer(best, r), r).otherwise(best))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    found = word_runs(documents).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query()
def op13_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into pieces of binary length, each of them a sequence of its own."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack_by_powers(documents, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, longest=2048)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
