"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, chat, embeddings, html_text, lines, packing, prefix_trie, quality, secrets, simhash, spelling, substring, topk

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], own.schema)
    return chat.read_back(chat.format_turns(own.unionByName(more)))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text less the passages that an earlier document holds, the bytes removed, and the ids that hold them."""
    out = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "removed_bytes", "source_doc_ids")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text less the lines that repeat earlier ones, and how many were removed."""
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "removed_lines")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ten = (op1_html_extraction, op2_chat_formatting, op3_best_fit_packing, op4_substring_dedup, op5_embedding_near_dedup, op6_line_dedup, op7_quality_classifier, op8_simhash_near_dedup, op9_exact_top_k, op10_bpe_round_trip)
    return {f.__name__: f for f in (*ten, op11_spelling_variants, op12_prefix_trie, op13_secret_scan)}


LINKS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
    link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    part AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY 1)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN part USING (vec_id) LEFT JOIN n USING (vec_id)"""
BEST_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(s AS BIGINT) AS score FROM (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.z, c.z) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.z, c.z) DESC, c.vec_id) AS rank FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id) WHERE rank <= 5"""


#: The steps of the CRC-32 of a byte, as a list t; and the checksum of a text over it.
CRC_STEPS = "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + octet_length(encode({0}))::BIGINT), lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295)"""
#: Words that are equal once a letter is replaced by a star or taken out are near.
SPELLING_SQL = f"""WITH RECURSIVE steps AS ({CRC_STEPS}), runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
    told AS (SELECT run, c, {CRC.format("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM runs, steps),
    words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM told) GROUP BY 1 HAVING sum(c) >= 3 AND length(word) >= 5),
    places AS (SELECT word, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM words, unnest(range(length(word))) AS p(i)),
    near AS (SELECT a.word, b.word AS other FROM places a JOIN places b ON a.head || '*' || a.tail = b.head || '*' || b.tail AND a.word <> b.word
        UNION SELECT word, head || tail FROM places WHERE head || tail IN (SELECT word FROM words) UNION SELECT head || tail, word FROM places WHERE head || tail IN (SELECT word FROM words)),
    best AS (SELECT r.word, count(*) AS n_near, min({{'n': -w.n, 'w': w.word}}) AS b FROM near r JOIN words w ON w.word = r.other GROUP BY 1),
    forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 2 * n THEN b.w END AS form, CASE WHEN -b.n >= 2 * n THEN -b.n END AS form_n FROM words LEFT JOIN best USING (word)),
    led AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT l.word, f.word, f.form FROM led l JOIN forms f ON f.word = l.next)
    SELECT f.word, n, n_near, form, form_n, l.at AS root FROM forms f JOIN led l ON l.word = f.word AND l.next IS NULL"""
TRIE_SQL = f"""WITH steps AS ({CRC_STEPS}), own AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base, {CRC.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own), steps),
    built AS (SELECT c.conv_id, 0 AS part, pos, r, x FROM convs c JOIN own o ON o.conv_id = c.base AND pos < h UNION ALL SELECT c.conv_id, 1, pos, r, x FROM convs c JOIN own o ON o.conv_id = c.conv_id AND pos >= h),
    paths AS (SELECT conv_id, list({{'r': r, 'x': x}}) OVER (PARTITION BY conv_id ORDER BY part, pos) AS path, count(*) OVER (PARTITION BY conv_id) AS turns FROM built
        UNION ALL SELECT conv_id, [], (SELECT count(*) FROM built b WHERE b.conv_id = c.conv_id) FROM convs c),
    nodes AS (SELECT path, len(path) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = len(path)), '')) AS ends FROM paths GROUP BY 1),
    below AS (SELECT path[:depth - 1] AS up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1), whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN below ON up = path),
    under AS (SELECT path[:k] AS top, count(*) FILTER (n_children = 0) AS n_leaves, sum(CASE WHEN depth > 0 THEN (n_convs - 1) * octet_length(encode(path[depth].x)) ELSE 0 END) AS saved FROM whole, unnest(range(depth + 1)) AS a(k) GROUP BY 1)
    SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256 FROM whole w JOIN under ON top = w.path LEFT JOIN nodes p ON w.depth > 0 AND p.path = w.path[:w.depth - 1]"""


#: Lines with equal sets stand for one; a set's earliest line goes if an earlier set is similar, all its later lines go anyhow.
LINES_SQL = """WITH lines AS (SELECT doc_id, i AS line, x[i] AS line_text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS r(i)),
    worded AS (SELECT doc_id, line, list_filter(string_split_regex(lower(line_text), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS w FROM lines),
    shingled AS (SELECT doc_id, line, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM worded WHERE len(w) > 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, line) AS n FROM shingled), sets AS (SELECT row_number() OVER (ORDER BY doc_id, line) AS age, doc_id, line, s, len(s) AS size FROM placed WHERE n = 1),
    tokens AS (SELECT age, size, unnest(s) AS t FROM sets), near AS (SELECT b.age FROM tokens a JOIN tokens b ON a.t = b.t AND a.age < b.age AND least(a.size, b.size) * 5 >= greatest(a.size, b.size) * 4 GROUP BY b.age, a.age, a.size, b.size HAVING count(*) * 5 >= (a.size + b.size - count(*)) * 4),
    gone AS (SELECT doc_id, line FROM placed WHERE n > 1 UNION SELECT doc_id, line FROM sets WHERE age IN (SELECT age FROM near))
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, CAST(coalesce(g.n, 0) AS INT) AS removed_lines FROM documents d
    LEFT JOIN (SELECT doc_id, string_agg(line_text, chr(10) ORDER BY line) AS text FROM lines WHERE (doc_id, line) NOT IN (SELECT (doc_id, line) FROM gone) GROUP BY 1) k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)"""


def _chat_sql(template: chat.Template = chat.INSTRUCT) -> str:
    def escaped(text: str) -> str:
        text = f"replace({text}, '\\', '\\\\')"
        for m in template.marks:
            text = f"replace({text}, '{m}', '{m[0]}\\{m[1:]}')"
        return text

    around = " ".join(f"WHEN '{r}' THEN {len(p.opening) + len(p.closing)}" for r, p in template.parts.items())
    loss = ", ".join(f"'{r}'" for r, p in template.parts.items() if p.loss)
    follows = " ".join(f"WHEN '{r}' THEN role IN ({', '.join(repr(x) for x in after)})" for r, after in template.follows.items())
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
    placed AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id {order}), '') AS before, {escaped("text")} AS safe, CASE role {around} ELSE {sum(map(len, template.other))} + length({escaped("role")}) END AS marks FROM said)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role IN ({loss})), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' {order}) FILTER (role IN ({loss})), '')) AS loss_sha256, CAST(sum(marks + length(safe)) AS BIGINT) AS formatted_chars, count(*) FILTER (NOT CASE before {follows} ELSE false END) AS turns_out_of_order FROM placed GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say what a query gives; the others are tested against brute force, a round trip, the library or held-out labels."""
    return {"op2_chat_formatting": _chat_sql(), "op5_embedding_near_dedup": LINKS_SQL, "op6_line_dedup": LINES_SQL, "op9_exact_top_k": BEST_SQL, "op11_spelling_variants": SPELLING_SQL, "op12_prefix_trie": TRIE_SQL}
