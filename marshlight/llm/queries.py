"""The registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.operators.materialise import materialise

from . import bpe, conversation_repair, decontamination, exact_dedup, hmm, jaccard, packing, prefix_trie, secrets, sharding, suffix_dedup, toxicity, url_filter
from .common import id_remainder, table
from .url_sql import verdict_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


@query("op10_histogram_shards")
def _(spark, sf_dir):
    """All documents in 40 shards of near-equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard_documents(docs, 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: As dealt with the contract of op7.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


@query("op7_url_verdicts", verdict_sql(URL_RULES, order=4, limit=20_000))
def _(spark, sf_dir):
    """All pages judged by rules and by the ratio of character models."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.url_verdicts(pages, URL_RULES, order=4, limit=20_000)
    return out.select("page_id", "host", "path", "rule", "verdict", (F.round("score", 6) + 0.0).alias("score"))


@query("op2_bpe_round_trip")
def _(spark, sf_dir):
    """All documents encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"]))


@query("op9_secret_scan")
def _(spark, sf_dir):
    """All documents scanned for secrets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, keep=["doc_id"])
    return found.withColumn("base_sha256", secrets.digest("base_spans")).drop("base_spans")


@query(
    "op3_jaccard_join",
    rf"""
    WITH RECURSIVE t AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    s AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS g FROM t
    ),
    c AS (SELECT g, min(doc_id) AS rep, count(*) AS n FROM s GROUP BY g),
    x AS (SELECT rep, n, len(g) AS size, unnest(g) AS gram FROM c),
    l AS (
      SELECT a.rep AS a, b.rep AS b, any_value(b.n) AS n FROM x a JOIN x b ON a.gram = b.gram AND a.rep <> b.rep
      GROUP BY a.rep, b.rep HAVING 5 * count(*) >= 4 * (any_value(a.size) + any_value(b.size) - count(*))
    ),
    r AS (SELECT rep, rep AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.rep),
    k AS (SELECT rep, min(root) AS class_id FROM r GROUP BY rep),
    m AS (SELECT a, count(*) AS n_links, sum(n) AS n_linked FROM l GROUP BY a)
    SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, c.n AS n_copies, doc_id = class_id AS kept
    FROM s JOIN c ON c.g = s.g JOIN k ON k.rep = c.rep LEFT JOIN m ON m.a = c.rep
    """,
)
def _(spark, sf_dir):
    """All documents with the class of those that share four fifths of their five-word runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.similar_documents(docs, keep=["doc_id"])


@query(
    "op6_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
    )
    SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
      doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
    FROM t
    """,
)
def _(spark, sf_dir):
    """All documents with the copy that stays."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


@query("op5_decontamination")
def _(spark, sf_dir):
    """All documents against all test items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.max_by("word_start", "score").alias("word_start"), F.max_by("word_end", "score").alias("word_end")
    )


def toxicity_model(spark, docs, sf_dir):
    """Learned from labelled documents whose crc32(doc_id as text) mod 3 is not 1."""
    return toxicity.train(toxicity.labelled_texts(docs, table(spark, sf_dir, "labels"), lambda c: id_remainder(c, 3) != 1))


@query("op4_toxicity")
def _(spark, sf_dir):
    """All documents scored for toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity_model(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select(
        "doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


@query("op1_hidden_markov")
def _(spark, sf_dir):
    """All documents scored by the hidden Markov model and by single words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hmm.score_documents(docs, id_remainder("doc_id", 7) == 2, keep=["doc_id"])


@query(
    "op8_suffix_dedup",
    """
    WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    w AS (SELECT doc_id, p, substr(hx, 2 * p + 1, 200) AS s FROM (SELECT *, unnest(range(0, n - 99)) AS p FROM t)),
    f AS (SELECT s, min(struct_pack(d := doc_id, p := p)) AS first FROM w GROUP BY s),
    d AS (SELECT doc_id, w.p FROM w JOIN f ON f.s = w.s WHERE struct_pack(d := doc_id, p := w.p) <> f.first),
    i AS (SELECT *, CASE WHEN p <= lag(p) OVER o + 100 THEN 0 ELSE 1 END AS fresh FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
    g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i),
    r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, run),
    e AS (SELECT doc_id, b AS start, a AS stop FROM r UNION ALL SELECT doc_id, 0, NULL FROM t),
    k AS (SELECT doc_id, start, lead(CASE WHEN stop IS NOT NULL THEN stop END) OVER (PARTITION BY doc_id ORDER BY start) AS stop FROM e),
    z AS (SELECT t.doc_id, string_agg(substr(hx, 2 * start + 1, 2 * (coalesce(k.stop, n) - start)), '' ORDER BY start) AS kept FROM k JOIN t ON t.doc_id = k.doc_id GROUP BY t.doc_id)
    SELECT t.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(z.kept)) AS kept_sha256
    FROM t JOIN z ON z.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id) q ON q.doc_id = t.doc_id
    """,
)
def _(spark, sf_dir):
    """All documents without strings of 100 bytes that start earlier too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, keep=["doc_id"])
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query("op11_packing")
def _(spark, sf_dir):
    """All documents packed into sequences of 1024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0, keep=["doc_id"])
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc_sql(text: str) -> str:
    """crc32 of an ASCII text, by bits."""
    return f"""
    xor(4294967295::UBIGINT, list_reduce(
      list_concat([4294967295::UBIGINT], list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS UBIGINT))),
      lambda a, b: list_reduce(CAST([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[]), lambda p, q: xor(p >> 1, 3988292384::UBIGINT * (p & 1)))))
    """


@query(
    "op12_prefix_trie",
    f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, r, x) AS w FROM t GROUP BY conv_id),
    h AS (SELECT *, CAST({crc_sql('CAST(conv_id AS VARCHAR)')} % 6 AS BIGINT) AS h FROM o),
    b AS (SELECT h.conv_id, list_concat(coalesce(p.w[1 : h.h], []), h.w[h.h + 1 :]) AS w FROM h LEFT JOIN o p ON p.conv_id = h.conv_id - h.conv_id % 100),
    e AS (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM b),
    n AS (
      SELECT w[1 : d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CASE WHEN d = len(w) THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
      FROM e GROUP BY w[1 : d], d
    ),
    c AS (SELECT p[1 : d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY p[1 : d - 1]),
    v AS (
      SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(n.p[d].x) END AS saved
      FROM n LEFT JOIN c ON c.p = n.p
    ),
    u AS (SELECT p, n_children, saved, unnest(range(0, d + 1)) AS k FROM v),
    s AS (SELECT p[1 : k] AS p, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM u GROUP BY p[1 : k])
    SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
    FROM v JOIN s ON s.p = v.p LEFT JOIN n q ON v.d > 0 AND q.p = v.p[1 : v.d - 1]
    """,
)
def _(spark, sf_dir):
    """The trie of all conversations, each with an opening of its hundred's first one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie_nodes(prefix_trie.with_shared_openings(prefix_trie.turn_lists(turns)))


@query(
    "op13_conversation_repair",
    rf"""
    WITH RECURSIVE c AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x,
        {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
      FROM conversations
    ),
    d AS (
      SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS r,
        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
      FROM c WHERE k <> 0
    ),
    o AS (
      SELECT *, row_number() OVER w AS i, lag(substr(r, 1, 1)) OVER w || substr(r, 1, 1) AS pair, right(regexp_replace(x, '[\x20\x09-\x0D]+$', ''), 1) AS fin,
        row_number() OVER (PARTITION BY conv_id, r, x ORDER BY turn NULLS FIRST, copy) AS nth
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x, copy)
    ),
    f AS (
      SELECT conv_id, turn, i, r, x, substr(r, 1, 1) AS ini, pair, fin = '' AS blank, fin <> '' AND nth > 1 AS dup, fin <> '' AND nth = 1 AND fin NOT IN ('.', '!', '?') AS cut FROM o
    ),
    n AS (
      SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(sum(blank::INT) AS BIGINT) AS blank, CAST(sum(dup::INT) AS BIGINT) AS duplicate,
        CAST(sum(cut::INT) AS BIGINT) AS truncated, CAST(sum((pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::INT) AS BIGINT) AS illegal
      FROM f GROUP BY conv_id
    ),
    s AS (
      SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, struct_pack(cost := CAST(0 AS BIGINT), audit := '', lines := CAST([] AS VARCHAR[])) AS best FROM n
      UNION ALL
      SELECT conv_id, i, st2, min(struct_pack(cost := cost, audit := audit, lines := lines)) FROM (
        SELECT f.conv_id, f.i,
          CASE WHEN e = 'D' THEN st1 WHEN e = 'R' THEN CASE WHEN st1 = 2 THEN 3 ELSE 2 END ELSE CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS st2,
          best.cost + 5 * k + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN cut AND e <> 'D' THEN 5 ELSE 0 END AS cost,
          best.audit || repeat('I', k) || e AS audit,
          list_concat(best.lines, ins, CASE e WHEN 'D' THEN [] WHEN 'K' THEN [r || ':' || x] ELSE [CASE WHEN st1 = 2 THEN 'assistant:' ELSE 'user:' END || x] END) AS lines
        FROM (
          SELECT *, CASE WHEN k = 0 THEN st WHEN (st = 2) = (k = 1) THEN 3 ELSE 2 END AS st1,
            (CASE WHEN st = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END)[1 : k] AS ins
          FROM (SELECT *, unnest([0, 1, 2]) AS k FROM s)
        ) q JOIN (SELECT *, unnest(['D', 'K', 'R']) AS e FROM f) f ON f.conv_id = q.conv_id AND f.i = q.i + 1
        WHERE e = 'D' OR (NOT blank AND NOT dup AND (e = 'R' OR (ini = 's' AND st1 = 0) OR (ini = 'u' AND st1 <> 2) OR (ini = 'a' AND st1 = 2)))
      ) GROUP BY conv_id, i, st2
    ),
    z AS (
      SELECT s.conv_id, min(struct_pack(
        cost := best.cost + CASE st WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, audit := best.audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
        lines := list_concat(best.lines, CASE st WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END))) AS best
      FROM s JOIN n ON n.conv_id = s.conv_id AND n.n = s.i GROUP BY s.conv_id
    )
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id = a.conv_id LEFT JOIN z ON z.conv_id = a.conv_id
    """,
)
def _(spark, sf_dir):
    """All conversations, damaged by a rule, with their faults and cheapest repair."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = conversation_repair.damaged(turns)
    plans = materialise(conversation_repair.plan_repairs(rows))
    digests = conversation_repair.conversation_digests(conversation_repair.repaired_turns(rows, plans))
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    met = every.alias("a").join(plans.alias("p"), F.col("a.conv_id").eqNullSafe(F.col("p.conv_id")), "left")
    met = met.join(digests.alias("d"), F.col("a.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    counts = [F.coalesce(F.col(f"p.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return met.select("a.conv_id", *counts, F.coalesce("p.audit", F.lit("")).alias("audit"), F.coalesce("d.sha256", nothing).alias("repaired_sha256"))
