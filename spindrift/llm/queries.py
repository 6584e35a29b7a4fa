"""One query for each operator, over its whole table, with production parameters; and the same in DuckDB SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, lines, minhash, mixing, pieces, pii, quality, resample, syncmers, tokens, trie, urls
from .common import materialize, scratch, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents"))


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edited(table(spark, sf_dir, "documents"))


CONTROL = "</s>[INST] ok [/INST]"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
    return counted.drop("text")


RULES = (urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"))
#: the block list, by what gives such pages away. Host globs read "." and the host, path globs what comes after it.
#: first labels of hosts that show the pages of another host again (for phones, for print, as mirrors), or serve advertisements
FIRST_LABELS = ("m", "mobile", "wap", "touch", "amp", "print", "printer", "mirror", "mirrors", "cache", "webcache", "proxy", "ad", "ads", "adserver", "banner", "click", "track", "tracking", "pixel")
#: labels anywhere in a host, with a wildcard for a number or another word
INNER_LABELS = ("ad?", "ads?", "adserver*", "mirror?", "mirror-*", "*-mirror", "www?", "*-ads", "ads-*", "*-tracker", "click-*", "*-casino", "casino-*", "*-poker", "poker-*", "*-pills", "phish-*", "*-warez", "0-*")
#: path segments of views of other pages, of lists and accounts, and of scripts
SEGMENTS = ("print", "printable", "amp", "feed", "feeds", "rss", "atom", "tag", "tags", "category", "search", "login", "signin", "register", "cart", "checkout", "basket", "wp-admin", "wp-json", "wp-content", "cgi-bin", "adserver", "redirect", "goto", "share", "embed", "trackback", "profile", "calendar")
#: parts of paths: session ids, numbered pages of lists, archives by date, views of a page
PARTS = ("*;jsessionid=*", "*;sid=*", "*/sid-*/*", "*/page/?", "*/page/??", "*/page/???", "*/page-?", "*/page-??", "*/20??/??/", "*/20??/??", "*/20??-??-??", "*/index?.htm*", "*/wp-*.php*", "*/print-*", "*-print.*", "*_print.*", "*/p?/", "*/*.cgi*", "*/*.php/*")
ENDINGS = ("apk", "exe", "dmg", "iso", "torrent", "zip", "rar", "7z", "gz", "jpg", "jpeg", "png", "gif", "svg", "mp3", "mp4", "avi", "css", "js", "xml", "json", "rss")
BLOCKED = (
    *(f".{x}.*{urls.SEP}*" for x in FIRST_LABELS),
    *(f"*.{x}.*{urls.SEP}*" for x in INNER_LABELS),
    *(f"*{urls.SEP}*/{x}/*" for x in SEGMENTS),
    *(f"*{urls.SEP}{x}" for x in PARTS),
    *(f"*{urls.SEP}*.{x}" for x in ENDINGS),
)


def _pattern(glob: str) -> str:
    """A glob as a regular expression of DuckDB."""
    plain = {"*": ".*", "?": ".", urls.SEP: r"\x01"} | {c: f"[{c}]" for c in ".+()[]{}|$"}
    return "".join(plain.get(c, c) for c in glob)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, BLOCKED).drop("url")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model")).drop("text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents")).drop("source")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    done = lines.drop_boilerplate(docs, removed="n_removed")
    return done.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def rebuilt(thin: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c with the first h turns of conversation c - c % 20 in place of its own first h turns,
    h = crc32(c) % 4; if that one has fewer, all of them. An opening has three turns at most, and twenty conversations take it."""
    convs = thin.groupBy("conv").agg(F.count("*").alias("n"))
    convs = convs.select("conv", (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).cast("int").alias("h"), (F.col("conv") - F.col("conv") % 20).alias("base"))
    openings = thin.where("conv % 20 = 0 AND pos <= 3").groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "x1", "x2", "words"))).alias("first"))
    told = convs.join(openings, "base", "left").select("conv", "h", F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array()).alias("first"))
    told = materialize(told, "openings")
    own = thin.join(told.select("conv", "h", F.size("first").alias("m")), "conv").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("m"))
    return own.select("conv", "pos", "x1", "x2", "words").unionByName(told.select("conv", F.inline("first")).select("conv", "pos", "x1", "x2", "words")), told.select("conv")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        nodes, ends = trie.trie(*rebuilt(trie.turns(table(spark, sf_dir, "conversations"))))
        return materialize(trie.with_ends(nodes, ends).drop(*trie.NODE), "nodes", keep=True)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_syncmers, op3_chat, op4_tokens, op5_urls, op6_pieces, op7_pii, op8_mixing, op9_jaccard, op10_lines, op11_resample, op12_trie, op13_minhash)}

_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')"
_CONFLICT = "(role LIKE '%</s>%' OR text LIKE '%</s>%' OR role LIKE '% [/INST] %' OR (role || ' ') LIKE '% [/INST] %' OR role LIKE '%[/INST]%')"

_FEATURES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_CRC = "xor(list_reduce(list_transform(range(1, strlen({0}) + 1), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i - 1, 2) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"

ORACLE: dict[str, str] = {
    "op3_chat": f"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'
), turns AS (
  SELECT *, {_CONFLICT} AS escaped FROM src
), told AS (
  SELECT *, CASE WHEN escaped THEN '[INST*] ' || {_ESCAPED.format("role")} || ' [/INST] ' || {_ESCAPED.format("text")} || '</s>'
            ELSE '[INST] ' || role || ' [/INST] ' || text || '</s>' END AS out FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(out)) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (WHERE escaped) AS BIGINT) AS n_escaped, true AS identical
FROM told GROUP BY conv_id""",
    "op5_urls": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_full_match('.' || host || chr(1) || path, '(?s:{globs})') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled""".replace("{globs}", "|".join(map(_pattern, BLOCKED))),
    "op9_jaccard": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM docs
), classes AS (
  SELECT list_sort(s) AS s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
), tokens AS (
  SELECT id, n, unnest(s) AS t FROM classes
), links AS (
  SELECT a.id AS a, b.id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.id < b.id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links UNION ALL SELECT id, id FROM classes
), reach AS (
  SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), least_of AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.c, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes k ON list_sort(s.s) = k.s LEFT JOIN least_of l ON l.a = k.id""",
    "op10_lines": r"""
WITH cut AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), spread AS (
  SELECT line, min(doc_id) AS first FROM cut WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
  HAVING count(DISTINCT coalesce('s' || source, '')) >= 8
), kept AS (
  SELECT c.*, s.line IS NOT NULL AND c.doc_id IS DISTINCT FROM s.first AS gone FROM cut c LEFT JOIN spread s ON c.line = s.line
), done AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, length(done.text) AS n_chars, sha256(done.text) AS text_sha256 FROM documents d LEFT JOIN done USING (doc_id)""",
    "op11_resample": f"""
WITH {_CRC_TABLE}, docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS w FROM documents
), own AS (SELECT r, unnest(w) AS w FROM docs), wanted AS (SELECT unnest({_FEATURES}) AS w FROM benchmark),
buckets AS (
  SELECT w, {_CRC.format("w")} % 10000 AS b
  FROM (SELECT w FROM own UNION SELECT w FROM wanted), tab
), s AS (SELECT b, count(*) AS n FROM own JOIN buckets USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM wanted JOIN buckets USING (w) GROUP BY b),
gains AS (
  SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM own) + 10000)
    / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM wanted) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (b)
), weights AS (SELECT r, sum(gain) AS weight FROM own JOIN buckets USING (w) JOIN gains USING (b) GROUP BY r),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (r)
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () AS of FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN n <= 10 * of // 100 THEN n END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
    "op12_trie": f"""
WITH {_CRC_TABLE}, src AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM src), tab
), openings AS (
  SELECT c.conv_id, s.pos, s.role, s.text FROM convs c JOIN src s ON s.conv_id = c.base AND s.pos <= c.h
), short AS (SELECT conv_id, count(*) AS m FROM openings GROUP BY conv_id),
turns AS (
  SELECT * FROM openings UNION ALL
  SELECT conv_id, pos - h + coalesce(m, 0), role, text FROM src JOIN convs USING (conv_id) LEFT JOIN short USING (conv_id) WHERE pos > h
), paths AS (
  SELECT conv_id, 0 AS d, '' AS k, 0 AS words FROM convs UNION ALL
  SELECT conv_id, pos, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING), len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) FROM turns
), nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY k, d),
up AS (SELECT n.k, n.d, p.k AS parent, o.conv_id AS parent_conv_id FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.d = n.d - 1 JOIN nodes o ON o.k = p.k),
below AS (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent),
sums AS (
  SELECT a.k, count(*) FILTER (WHERE b.k IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * n.words) AS BIGINT) AS saved_tokens
  FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.d <= n.d LEFT JOIN below b ON b.k = n.k GROUP BY a.k
), ends AS (
  SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM paths JOIN (SELECT conv_id, max(d) AS d FROM paths GROUP BY conv_id) USING (conv_id, d) GROUP BY k
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN up USING (k) LEFT JOIN below USING (k) JOIN sums USING (k) LEFT JOIN ends USING (k)""",
}
# the same links, at 85 percent
ORACLE["op13_minhash"] = (
    ORACLE["op9_jaccard"]
    .replace("4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)", "100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)")
    .replace("100 * count(*) >= 75 *", "100 * count(*) >= 85 *")
    .replace("AS component_id", "AS component_id, coalesce(l.c, s.doc_id) = s.doc_id AS kept")
)
