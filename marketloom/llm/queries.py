"""The registered queries of the corpus operators, with production parameters on whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.chat import BODY, CONTROL, OTHER, TAGS, closing, digest_turns, expand_replies, opening, read_back
from marketloom.llm.decontam import digest_hits, search_benchmark
from marketloom.llm.gif import media_features
from marketloom.llm.jaccard import jaccard_components
from marketloom.llm.langid import held_out, identify, train
from marketloom.llm.line_dedup import dedup_lines
from marketloom.llm import toxicity
from marketloom.llm.lexical import TERM, rank_documents
from marketloom.llm.merkle import leaf_of, manifest
from marketloom.llm.mixing import Targets, mix_documents
from marketloom.llm.suffix_dedup import dedup_strings
from marketloom.llm.url_filter import filter_urls
from marketloom.llm.warc import archive_pages

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Equal shares of the sources, 40 % English, rare topics lifted; half of all tokens are sampled.
MIX_TARGETS = Targets(source={f"src{k}": 1.0 for k in range(20)}, lang={"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2})
MIX_FRACTION = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__kept_sha256").alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(4, 2)
    out = toxicity.score_texts(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), ~held))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_strings(table(spark, sf_dir, "documents")).drop("spans")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_hits(search_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(3, 1)
    out = identify(docs.select("doc_id", "text"), train(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), MIX_TARGETS, MIX_FRACTION).drop("key")


#: A conversation that says what the template's marks are made of.
MARKS_CONVERSATION, MARKS_TEXT = -7, "</s>[INST] ok [/INST]"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = spark.range(2).select(F.lit(MARKS_CONVERSATION).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS_TEXT).alias("text"))
    return digest_turns(read_back(expand_replies(given.unionByName(two))))


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    found = [F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")) if c == "text" else F.col(c) for c in MANIFEST_FIELDS]
    out = manifest(docs, MANIFEST_FIELDS, "source", "doc_id", seen=leaf_of(found))
    return out.withColumnRenamed("order", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL_UPPER, SQL_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 of a decimal doc_id, bit by bit.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(d)::BIGINT FOR d IN string_split(doc_id::VARCHAR, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

ORACLE = {
    "op2_warc": """
        WITH digests AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), named AS (
          SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
              1 + ((('0x' || substr(hex || '0', 5 * i // 4 + 1, 2))::INTEGER >> (3 - (5 * i) % 4)) & 31), 1) FOR i IN range(32)], '') AS payload_digest FROM digests
        ), firsts AS (SELECT hex, min(page_id) AS first_id FROM digests GROUP BY hex)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM named JOIN firsts USING (hex)""",
    "op3_line_dedup": rf"""
        WITH lines AS (
          SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
        ), keyed AS (
          SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{SQL_UPPER}', '{SQL_LOWER}') AS key
          FROM lines
        ), repeated AS (
          SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), judged AS (
          SELECT k.doc_id, pos, line, coalesce(k.doc_id < keeper, false) AS drop_it FROM keyed k LEFT JOIN repeated r USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop_it) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop_it), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op4_url_filter": rf"""
        WITH cut AS (
          SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_replace(substr(url, instr(url, '://') + 3), '[?#](.|\n)*$', '') ELSE '' END AS rest FROM pages
        ), parts AS (
          SELECT page_id, translate(CASE WHEN instr(rest, '/') > 0 THEN substr(rest, 1, instr(rest, '/') - 1) ELSE rest END, '{SQL_UPPER}', '{SQL_LOWER}') AS host,
                 CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM cut
        ), rules(rule_verdict, rule_host, rule_path) AS (
          VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}
        ), fits AS (
          SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
          FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)""",
    "op5_jaccard_join": rf"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{SQL_UPPER}', '{SQL_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
          SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS gram FROM words, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i) WHERE len(w) > 0
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON r = x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op7_suffix_dedup": rf"""
        WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        strings AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 800)) AS g FROM texts, unnest(range(0, greatest(0, len(x) // 2 - 399))) AS t(i)),
        repeated AS (SELECT doc_id, i FROM strings WHERE g IN (SELECT g FROM strings GROUP BY g HAVING count(*) > 1)),
        numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
          FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM repeated)),
        runs AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY doc_id, run),
        parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM runs),
        kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) AS before
          FROM parts JOIN texts USING (doc_id) GROUP BY doc_id),
        words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{SQL_UPPER}', '{SQL_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (SELECT doc_id, i, hash(array_to_string(w[i : i + 50], ' ')) AS g FROM words, unnest(range(1, greatest(0, len(w) - 50) + 1)) AS t(i)),
        again AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM grams WHERE g IN (SELECT g FROM grams GROUP BY g HAVING count(*) > 1)),
        passages AS (SELECT doc_id, sum(least(51, coalesce(next - i, 51)))::BIGINT AS n_passage_words FROM again GROUP BY doc_id)
        SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(before, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(n_passage_words, 0) AS n_passage_words
        FROM texts LEFT JOIN kept USING (doc_id) LEFT JOIN passages USING (doc_id)""",
    "op8_decontamination": rf"""
        WITH item_words AS (
          SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{SQL_UPPER}', '{SQL_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
          SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
          FROM item_words, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0
        ), doc_words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{SQL_UPPER}', '{SQL_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), hits AS (
          SELECT doc_id, item, n, i FROM (
            SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
            FROM doc_words, (SELECT DISTINCT n FROM windows) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)
          ) JOIN windows USING (n, gram)
        ), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_chat": rf"""
        WITH given AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES ({MARKS_CONVERSATION}, 0, 'user', '{MARKS_TEXT}'), ({MARKS_CONVERSATION}, 1, 'assistant', '{MARKS_TEXT}')
        ), turns AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
                 length(regexp_replace(text, '{CONTROL}', '\1\\\2', 'g')) + CASE role {" ".join(f"WHEN '{role}' THEN {len(opening(tag) + closing(tag))}" for role, tag in TAGS.items())}
                 ELSE {len(opening(OTHER) + BODY + closing(OTHER))} + length(regexp_replace(role, '{CONTROL}', '\1\\\2', 'g')) END AS n FROM given
        ), summed AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM turns)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               (coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0) + CASE WHEN max_by(role, k) = 'assistant' THEN 0 ELSE max(upto) END)::BIGINT AS formatted_chars
        FROM summed GROUP BY conv_id""",
    "op12_manifest": rf"""
        WITH RECURSIVE given AS (
          SELECT doc_id, coalesce('s' || source, '') AS tree, text,
                 concat({", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in MANIFEST_FIELDS[:-1])}) AS head,
                 CASE WHEN {CRC32_SQL} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found FROM documents
        ), leaves AS (
          SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(found) || ':' || found, '-')) AS seen FROM given
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
        nodes(tree, lev, pos, n, h) AS (
          SELECT tree, 0, pos, n, leaf FROM ranked
          UNION ALL SELECT tree, lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, lev, n, pos // 3
        ), subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops(tree, lev, pos, n, h) AS (
          SELECT 't', 0, pos, n, subroot FROM subroots
          UNION ALL SELECT tree, lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY tree, lev, n, pos // 3
        ), every AS (SELECT * FROM nodes UNION ALL SELECT * FROM tops),
        sides AS (
          SELECT a.tree, a.lev, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
          FROM every a JOIN every b ON a.tree = b.tree AND a.lev = b.lev AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.lev, a.pos
        ), walk(doc_id, leaf, own, tree, lev, pos, h, proof) AS (
          SELECT doc_id, leaf, tree, tree, 0, pos, seen, '' FROM ranked
          UNION ALL SELECT doc_id, leaf, own, tree, lev + 1, pos // 3, sha256(l || h || r), proof || l || r FROM walk JOIN sides USING (tree, lev, pos)
        ), up(doc_id, leaf, own, tree, lev, pos, h, proof) AS (
          SELECT doc_id, leaf, own, 't', 0, s.pos, h, proof FROM (SELECT * FROM walk QUALIFY lev = max(lev) OVER (PARTITION BY tree)) w JOIN subroots s ON s.tree = w.own
          UNION ALL SELECT doc_id, leaf, own, tree, lev + 1, pos // 3, sha256(l || h || r), proof || l || r FROM up JOIN sides USING (tree, lev, pos)
        )
        SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, up.h AS folded_root, up.h = t.h AS verified
        FROM up JOIN tops t ON t.n = 1 AND up.lev = t.lev JOIN subroots s ON s.tree = up.own""",
    "op13_search": rf"""
        WITH texts AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{SQL_UPPER}', '{SQL_LOWER}'), '{TERM}') AS w FROM documents
        ), sizes AS (SELECT r, doc_id, w, len(w) AS n FROM texts WHERE len(w) > 0),
        whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{SQL_UPPER}', '{SQL_LOWER}'), '{TERM}')) AS term FROM benchmark),
        counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM sizes) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM counts, whole GROUP BY term, docs),
        impacts AS (
          SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS part FROM counts JOIN weights USING (term) JOIN sizes USING (r), whole
        ), scored AS (SELECT item_id, r, sum(part)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(part) > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
        FROM scored JOIN sizes USING (r) QUALIFY rank <= 10""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
