"""F1 to F20, F23, T16, U6 as expressions over the tables."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars as S
from ..functions import text as X
from ..operators import metadata


def r6(c, n):
    return F.round(c, 6).alias(n)


@query("F1_slugify", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'axis') AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", S.slugify(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("F2_collapse_and_humanise", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, upper(substr(x, 1, 1)) || substr(x, 2) AS title FROM (SELECT *, trim(regexp_replace(regexp_replace(role || '_turn-' || turn, '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM conversations)")
def _(t):
    return t.conversations.select("conv_id", "turn", S.collapse_space(F.col("text")).alias("flat"), S.humanise(F.concat("role", F.lit("_turn-"), "turn")).alias("title"))


@query("F3_session_name", "SELECT c_custkey, coalesce(nullif(substr(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(s, '[\\\\/]+', ' ', 'g'), '[^A-Za-z0-9._ -]+', ' ', 'g')), '\\s+', '_', 'g'), '^[._\\- ]+|[._\\- ]+$', '', 'g'), 1, 80), ''), 'session') AS name FROM (SELECT c_custkey, '  ..' || c_mktsegment || '/' || replace(c_name, '#', '\\') || '! ' AS s FROM customer)")
def _(t):
    s = F.concat(F.lit("  .."), "c_mktsegment", F.lit("/"), F.replace(F.col("c_name"), F.lit("#"), F.lit("\\")), F.lit("! "))
    return t.customer.select("c_custkey", S.session_name(s).alias("name"))


@query("F4_path_parts_and_extract", "SELECT page_id, split_part(p, '/', -1) AS base, regexp_replace(split_part(p, '/', -1), '(.)\\.[^.]*$', '\\1') AS stem, TRY_CAST(regexp_extract(p, '/([0-9]+)', 1) AS INT) AS number FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS p FROM pages)")
def _(t):
    p = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    return t.pages.select("page_id", S.basename(p).alias("base"), S.stem(S.basename(p)).alias("stem"), F.regexp_extract(p, "/([0-9]+)", 1).try_cast("int").alias("number"))


@query("F5_attribute_type", "SELECT i, CASE WHEN x IN ('categorical', 'nominal', 'class', 'classes', 'discrete', 'category', 'categories') THEN 'categorical' WHEN x IN ('ordinal', 'ordered', 'ranked', 'rank', 'ranking') THEN 'ordinal' WHEN x IN ('continuous', 'numeric', 'number', 'scalar', 'real') THEN 'continuous' WHEN contains(x, 'categor') THEN 'categorical' WHEN contains(x, 'ordin') OR contains(x, 'rank') THEN 'ordinal' WHEN contains(x, 'contin') OR contains(x, 'numeric') OR contains(x, 'scalar') THEN 'continuous' ELSE '' END AS type FROM (SELECT event_id AS i, lower(trim(['Nominal', ' rank ', 'REAL', 'sub-category', 'by ranks', 'continuum', 'colour', '', 'Numeric scale'][event_id % 9 + 1])) AS x FROM events)")
def _(t):
    words = F.array(*[F.lit(w) for w in ("Nominal", " rank ", "REAL", "sub-category", "by ranks", "continuum", "colour", "", "Numeric scale")])
    return t.events.select(F.col("event_id").alias("i"), S.attribute_type(F.get(words, (F.col("event_id") % 9).cast("int"))).alias("type"))


@query("F6_phrase_exact", r"""
WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, lower(text) AS t, trim(lower(coalesce(w[3], '') || ' ' || coalesce(w[4], ''))) AS p FROM w)
SELECT conv_id, turn, CASE WHEN p <> '' AND strpos(t, p) > 0 THEN strpos(t, p) - 1 END AS start FROM p""")
def _(t):
    """Where a phrase of the text's third and fourth word stands as it is; whole texts, line feeds included."""
    w = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    phrase = F.trim(F.lower(F.concat(F.coalesce(F.get(w, F.lit(2)), F.lit("")), F.lit(" "), F.coalesce(F.get(w, F.lit(3)), F.lit("")))))
    c = t.conversations.select("conv_id", "turn", "text", phrase.alias("phrase"))
    found = X.align_phrases(c.withColumn("phrases", F.array("phrase")), "text", "phrases").withColumn("s", F.get("spans", F.lit(0)))
    verbatim = F.lower(F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))) == F.col("phrase")
    return found.select("conv_id", "turn", F.when(verbatim, F.col("s.start")).cast("long").alias("start"))


@query("F6_phrase_fuzzy")
def _(t):
    c = t.conversations.select("conv_id", "turn", "text", F.array(F.concat(F.substring("text", 3, 12), F.lit("x")), F.lit("no such phrase")).alias("phrases"))
    return X.align_phrases(c, "text", "phrases").select("conv_id", "turn", F.explode("spans").alias("s")).select("conv_id", "turn", "s.phrase", "s.start", "s.end", F.round("s.score", 4).alias("score"))


@query("F7_parse_bool", "SELECT i, CASE WHEN x IN ('1', 'true', 'yes', 'y', 'on') THEN true WHEN x IN ('0', 'false', 'no', 'n', 'off') THEN false END AS flag FROM (SELECT event_id AS i, lower(trim(['Yes', ' no', 'ON', 'off', '1', '0', 'maybe', '', 'TRUE', 'f'][event_id % 10 + 1])) AS x FROM events)")
def _(t):
    words = F.array(*[F.lit(w) for w in ("Yes", " no", "ON", "off", "1", "0", "maybe", "", "TRUE", "f")])
    return t.events.select(F.col("event_id").alias("i"), S.parse_bool(F.get(words, (F.col("event_id") % 10).cast("int"))).alias("flag"))


@query("F8_parse_number", "SELECT i, CASE WHEN isfinite(TRY_CAST(trim(x) AS DOUBLE)) THEN TRY_CAST(trim(x) AS DOUBLE) END AS num FROM (SELECT event_id AS i, ['12', ' 3.5 ', '1e3', 'nan', 'inf', '-Infinity', 'abc', '', '-0.25'][event_id % 9 + 1] AS x FROM events)")
def _(t):
    words = F.array(*[F.lit(w) for w in ("12", " 3.5 ", "1e3", "nan", "inf", "-Infinity", "abc", "", "-0.25")])
    return t.events.select(F.col("event_id").alias("i"), S.parse_number(F.get(words, (F.col("event_id") % 9).cast("int"))).alias("num"))


@query("F9_format_number", "SELECT event_id, CASE WHEN abs(value - round_even(value, 0)) < 1e-6 THEN CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.3f', value), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END AS label, CASE WHEN abs(value) >= 100 THEN printf('%.0f', value) WHEN abs(value) >= 10 THEN printf('%.1f', value) WHEN abs(value) >= 1 THEN printf('%.2f', value) ELSE regexp_replace(regexp_replace(printf('%.3f', value), '0+$', ''), '\\.$', '') END AS short FROM (SELECT event_id, value + 0.001 AS value FROM events)")
def _(t):
    v = F.col("value") + F.lit(0.001)
    return t.events.select("event_id", S.trim_number(v).alias("label"), S.axis_number(v).alias("short"))


@query("F10_math", "SELECT event_id, round(1 / (1 + exp(-x)), 6) AS sig, round(CASE WHEN x > 0 THEN log10(x) END, 6) AS lg, round(greatest(x, 0.5) + ln(1 + exp(-abs(x - 0.5))), 6) AS lae, round(least(greatest(x, 0), 1), 6) AS cl FROM (SELECT event_id, value - 20 AS x FROM events)")
def _(t):
    x = F.col("value") - 20
    return t.events.select("event_id", r6(S.sigmoid(x), "sig"), r6(S.log10_or_null(x), "lg"), r6(S.logaddexp(x, F.lit(0.5)), "lae"), r6(S.clamp(x), "cl"))


@query("F10_softmax", "SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p FROM (SELECT vec_id, list_transform(embedding[1:4], lambda x: exp(x::DOUBLE - list_max(embedding[1:4])::DOUBLE)) AS e FROM embeddings)")
def _(t):
    e = t.embeddings.select("vec_id", F.slice("embedding", 1, 4).cast("array<double>").alias("a"))
    return e.select("vec_id", F.transform(S.softmax(F.col("a")), lambda x: S.rounded(x, 6)).alias("p"))


@query("F11_binning", "SELECT p_partkey, 'bin_' || lpad(CAST((p_size >= 10)::INT + (p_size >= 20)::INT + (p_size >= 35)::INT AS VARCHAR), 2, '0') AS bin, lpad(CAST(CAST(floor(p_size / 10) * 10 AS INT) AS VARCHAR), 3, '0') || 's' AS decade, CAST(least(floor(p_size / 50.0 * 5), 4) AS INT) AS class FROM part")
def _(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", S.bin_label(s, [10, 20, 35]).alias("bin"), S.age_decade(s).alias("decade"), S.floor_class(s / F.lit(50.0), 5).alias("class"))


@query("F12_fixed_bounds_normalise", "SELECT c_custkey, round(least(greatest((c_acctbal + 500) / 8000.0, 0), 1), 9) AS x FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.round(S.fixed_norm(F.col("c_acctbal"), -500, 7500), 9).alias("x"))


@query("F13_unit_hash", "SELECT c_custkey, round(CAST(('0x' || substr(md5(c_name), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551615.0::DOUBLE, 9) AS u FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.round(S.unit_hash(F.col("c_name")), 9).alias("u"))


@query("F14_ordered_bins", """
WITH v AS (SELECT p_type, row_number() OVER (ORDER BY lower(p_type), p_type) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT p_type FROM part))
SELECT p_partkey, round((idx + 1) / n::DOUBLE + (CAST(('0x' || substr(md5('p_type|' || p_partkey), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551615.0::DOUBLE - 1) / (2 * n), 9) AS coord, round((idx + 0.75) / n, 9) AS tick FROM part JOIN v USING (p_type)""")
def _(t):
    b = metadata.ordered_bins(t.part.select("p_partkey", "p_type"), "p_type", "p_partkey", "p_type")
    return b.select("p_partkey", F.round("coord", 9).alias("coord"), F.round("tick", 9).alias("tick"))


@query("F15_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def _(t):
    return t.events.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"))


@query("F16_array_resample", "SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN [] ELSE [w[1], w[1 + CAST(round((len(w) - 1) * 0.5) AS INT)], w[len(w)]] END AS r FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)")
def _(t):
    return t.conversations.select("conv_id", "turn", S.resample(F.split("text", " "), 3).alias("r"))


@query("F17_map_merge", "SELECT event_id, event_type AS kind, round(value, 4) AS v FROM events")
def _(t):
    a = F.create_map(F.lit("kind"), F.lit("none"), F.lit("id"), F.col("event_id").cast("string"))
    b = F.create_map(F.lit("kind"), F.col("event_type"))
    m = S.merge_maps(a, b)
    return t.events.select(F.element_at(m, "id").cast("long").alias("event_id"), F.element_at(m, "kind").alias("kind"), F.round("value", 4).alias("v"))


@query("F18_json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def _(t):
    text = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n``` thanks"))
    return X.first_json(t.events.select("event_id", text.alias("text")), "text", "json").select("event_id", F.get_json_object("json", "$.k").cast("int").alias("k"))


@query("F18_json_first_object")
def _(t):
    text = F.concat(F.lit("{broken {"), "props", F.lit(" and {\"a\": {\"b\": [1, {\"c\": \"}\"}]}}"))
    return X.first_json(t.events.select("event_id", text.alias("text")), "text", "json").select("event_id", "json")


@query("F19_prompts", "SELECT DISTINCT p_type, 'an image with high presence of ' || p_type AS much, 'an image with very little ' || p_type AS little FROM part")
def _(t):
    p = t.part.select("p_type").distinct()
    return p.select("p_type", F.get(S.presence_prompts(F.col("p_type")), F.lit(1)).alias("much"), F.get(S.presence_prompts(F.col("p_type"), S.LITTLE), F.lit(2)).alias("little"))


@query("F20_discrete_axis", "WITH h AS (SELECT p_size FROM part ORDER BY p_partkey LIMIT 600) SELECT count(DISTINCT p_size) AS distinct_values, count(*) AS n, count(DISTINCT p_size) <= greatest(6, sqrt(count(*))) AS discrete FROM h")
def _(t):
    return metadata.is_discrete_axis(t.part.select("p_partkey", "p_size"), "p_size", "p_partkey").select(F.col("distinct").alias("distinct_values"), "n", "discrete")


@query("F23_percent_segments", "SELECT event_id, CAST(least(floor(p / 10) + 1, 10) AS INT) AS decile, CAST(least(floor(p / 10), 9) AS INT) * 10 + 5 AS centre FROM (SELECT event_id, least(value, 100) AS p FROM events)")
def _(t):
    d = S.percent_segment(F.least(F.col("value"), F.lit(100.0)))
    return t.events.select("event_id", d.alias("decile"), S.decile_centre(d - 1).alias("centre"))


@query("T16_stable_seed")
def _(t):
    return t.orders.select("o_orderkey", S.stable_seed(F.lit("run"), F.col("o_orderpriority"), F.col("o_orderkey")).alias("seed"))


@query("U6_ordered_list_union", "SELECT p_partkey, p_type || '|' || p_name || '|' || p_brand AS u FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(S.ordered_union(F.array("p_type", "p_name"), F.array("p_brand", "p_type")), "|").alias("u"))
