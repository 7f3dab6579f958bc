"""Contract queries ``opN_<name>``: each applies its operator, with production
parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complexa.llm import chat_trees, collocations, decontaminate, exact_dedup, language, ngram_join, ngram_lm, packing, ranked_search, secrets, substring_dedup, toxicity, warc
from complexa.llm.common import table, work_table
from complexa.session import ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_secrets")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("grammar"))


#: Lower-casing of A-Z only, as every word contract asks.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op2_ngram_jaccard", oracle=rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.c + y.c - i)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.c), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_groups(table(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")


@query("op3_warc", oracle="""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(spark, table(spark, sf_dir, "pages")).drop("target_uri", "payload")


@query("op4_exact_dedup", oracle=r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op6_decontaminate", oracle=r"""
WITH t AS (SELECT doc_id AS id, 0 AS kind, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
w AS (SELECT id, kind, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (SELECT id, kind, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END)) AS g FROM w),
q AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY id),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.g = i.g AND d.kind = 0 AND i.kind = 1 GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared FROM p JOIN q ON q.id = p.item_id WHERE 100 * n_shared >= 80 * n_item""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train_network(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, net).select(
        "doc_id", (ngram_lm.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


_ESC = r"replace(replace(replace({0}, '\', '\b'), '#', '\h'), '<', '\l')"
_PLANTED = r"\### Assistant: </turn> ok"


@query("op7_chat_trees", oracle=rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{_PLANTED}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(replace({_ESC.format('role')}, ':', '\c')) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql("select -7L as conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role)").withColumn("text", F.lit(_PLANTED))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    messages = work_table(chat_trees.turns_as_tree(rows), "messages")
    done = chat_trees.format_paths(messages, chat_trees.best_paths(messages)).withColumn("turns", chat_trees.parse_formatted(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_trees.masked_text(F.col("formatted"), F.col("loss_mask"))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op8_substring_dedup", oracle=r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest([{'i': i, 's': md5(array_to_string(ws[i:i + 34], ' '))} FOR i IN range(1, len(ws) - 33)], recursive := true) FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM g) WHERE c > 1),
k AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range(0, 35) t(j)),
x AS (SELECT doc_id, unnest([{'i': i, 'v': ws[i]} FOR i IN range(1, len(ws) + 1)], recursive := true) FROM w),
s AS (SELECT x.doc_id, string_agg(x.v, ' ' ORDER BY x.i) AS t, count(*) AS n FROM x ANTI JOIN k USING (doc_id, i) GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.t, '')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), texts=False).drop("rid", "kept_text")


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).select(
        F.col("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op10_lm_trie")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.lm_scores(spark, table(spark, sf_dir, "documents"), ngram_lm.ORDER).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_language")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


@query("op12_ranked_search", oracle=rf"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS MATERIALIZED (SELECT id, doc_id, len(ts) AS n, ts FROM t WHERE len(ts) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS MATERIALIZED (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
f AS MATERIALIZED (
  SELECT id, doc_id, n, term, count(*) AS tf FROM (SELECT id, doc_id, n, unnest(ts) AS term FROM d)
  SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM f, s GROUP BY term),
i AS (SELECT id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))) AS impact FROM f JOIN w USING (term), s),
x AS (SELECT item_id, id, any_value(doc_id) AS doc_id, CAST(sum(q * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_PHRASES = r"""
WITH p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
q AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM q GROUP BY lang),
o AS (SELECT lang, id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM q),
w AS (
  SELECT lang, w1, lead(w1, 1) OVER z AS w2, lead(w1, 2) OVER z AS w3, lead(w1, 3) OVER z AS w4
  FROM o WINDOW z AS (PARTITION BY lang, id ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, 1 AS k, w1 AS phrase FROM w UNION ALL
    SELECT lang, 2, w1 || ' ' || w2 FROM w UNION ALL
    SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM w UNION ALL
    SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM w)
  WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
parts AS MATERIALIZED (
  SELECT lang, phrase, k, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cut AS (
  SELECT p.lang, p.phrase, p.k, p.a, j, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * p.a // (x.a + y.a) AS BIGINT) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.head JOIN f y ON y.lang = p.lang AND y.phrase = p.tail),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1),
inner_of AS (
  SELECT c.lang, s AS k, array_to_string(c.ws[i:i + s - 1], ' ') AS phrase, max(c.a) AS longest
  FROM c, range(2, 4) q(s), range(1, 4) p(i) WHERE s < c.k AND i + s - 1 <= c.k GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_of o ON o.lang = b.lang AND o.k = b.k AND o.phrase = b.phrase
  WHERE o.longest IS NULL OR 100 * CAST(o.longest AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


@query("op13_collocations", oracle=_PHRASES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
