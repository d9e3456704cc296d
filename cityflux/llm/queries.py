"""Every operator's query by name, over the whole given tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityflux.llm import chat, codes, language, lexical, licenses, lm, mixing, neighbours, packing, quality, simhash, urls, warc
from cityflux.llm.common import table
from cityflux.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


_CHAT = "regexp_replace({0}, '([<\\[])(\\\\*)(INST\\]|/INST\\]|MORE\\]|/s>)', '\\1\\\\\\2\\3', 'g')"
_ADDED = "</s>[INST] ok [/INST]"


@query(
    "op1_chat_format",
    f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{_ADDED}'), (-7, 1, 'assistant', '{_ADDED}'))
), marked AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS joins FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_CHAT.format('text')}) + CASE WHEN joins THEN 6 ELSE 17 + length({_CHAT.format('role')}) END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""",
)
def op1(spark, sf):
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_ADDED).alias("text"))
    given = table(spark, sf, "conversations")
    rows = given.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(added)
    return chat.digest(chat.format_conversations(rows))


@query("op2_best_fit_packing")
def op2(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query("op3_language_id")
def op3(spark, sf):
    return language.identify(table(spark, sf, "documents"))


@query("op4_lm_scoring")
def op4(spark, sf):
    return lm.score(table(spark, sf, "documents"))


@query("op5_license_scan", licenses.oracle())
def op5(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query(
    "op6_quality_rules",
    rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format('text')} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i+1], w[i+2]])) AS g FROM d WHERE len(w) > 2
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words
  FROM d LEFT JOIN covered c USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 6 * n_words OR 100 * n_dup_lines > 40 * n_lines
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_letter_words < 30 * n_words) AS kept
FROM b""",
)
def op6(spark, sf):
    return quality.judge(table(spark, sf, "documents"))


@query("op7_source_mixing")
def op7(spark, sf):
    taken = mixing.mix(table(spark, sf, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@query("op8_url_filters")
def op8(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = pages.join(table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id").select("url", "bad")
    return urls.judge(pages, labelled)


@query("op9_simhash_near_dedup")
def op9(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op10_nearest_neighbours")
def op10(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return neighbours.search(vectors, neighbours.every(vectors))


@query(
    "op11_warc_archive",
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), r AS (
  SELECT *, row_number() OVER w AS n, first_value(page_id) OVER w AS origin FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST)
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (5 * (3 - k % 4))) % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN origin END AS refers_to
FROM r""",
)
def op11(spark, sf):
    return warc.archive(table(spark, sf, "pages"))


def _codes_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    """Rounds of assignment and averaging over all pairs of part and entry, written out one after another."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT r, part, min(distance * {entries} + entry) AS best FROM (
    SELECT p.r, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS distance
    FROM parts p JOIN book{k} b USING (part)) GROUP BY r, part
)""")
        if k < rounds:
            steps.append(f"""
moved{k} AS (
  SELECT part, best % {entries} AS entry, place, sum(p.v[place])::BIGINT AS s, count(*)::BIGINT AS n
  FROM near{k} JOIN parts p USING (r, part), (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS place) GROUP BY 1, 2, 3
), book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM moved{k} GROUP BY part, entry) m USING (part, entry)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), parts AS MATERIALIZED (
  SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM kept, (SELECT unnest(range(0, {parts})) AS part)
), book0 AS MATERIALIZED (SELECT part, r AS entry, v FROM parts WHERE r < {entries}),{",".join(steps)}
, books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
), coded AS (
  SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM near{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), books"""


@query("op12_vector_codes", _codes_sql())
def op12(spark, sf):
    coded = codes.compress(table(spark, sf, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op13_lexical_search",
    f"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents
), d AS (SELECT doc_id, r, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0
), whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d
), q AS (
  SELECT item_id, row_number() OVER () AS i, unnest(list_distinct({_TERMS})) AS t FROM benchmark
), asked AS (SELECT DISTINCT t FROM q
), tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) SEMI JOIN asked USING (t) GROUP BY r, t
), weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY t
), impacts AS (
  SELECT tf.r, tf.t, weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS impact
  FROM tf JOIN weights ON tf.t = weights.t JOIN d ON tf.r = d.r, whole
), scores AS (
  SELECT i, item_id, r, sum(impact)::BIGINT AS score FROM q JOIN impacts USING (t) GROUP BY i, item_id, r
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN d USING (r) WHERE score > 0
) WHERE rank <= 10""",
)
def op13(spark, sf):
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
