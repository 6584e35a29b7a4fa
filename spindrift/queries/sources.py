"""What is read and written, through the shared folder where a round trip needs one."""

from pyspark.sql import functions as F

from ..catalog import query
from ..session import folder as shared_folder
from ..sources import tables as S


def folder(t, name):
    return shared_folder(t.spark, name)


@query("S1_S2_list_files", "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' AS id")
def _(t):
    f = S.list_items(t.spark, t.sf_dir, "*", True).where("bytes > 0")
    # a table may be one file, or a folder of files
    return f.select(F.regexp_extract("path", r"([^/]+\.parquet)(?:/[^/]*)?$", 1).alias("id")).distinct()


@query("S3_S5_metadata_csv_round_trip", "SELECT CAST(p_partkey AS VARCHAR) AS image, p_name AS name, CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size FROM part")
def _(t):
    p = t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("image"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("size"))
    S.write_metadata(p, path := folder(t, "metadata"))
    return S.read_metadata(t.spark, path)


@query("S4_json_rows", "SELECT CAST(p_partkey AS VARCHAR) AS image, p_name AS name, CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size FROM part")
def _(t):
    p = t.part.select(F.col("p_partkey").alias("image"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("size"))
    p.write.json(path := folder(t, "rows"))
    return S.read_rows(t.spark, path, "jsonl").select("image", "name", "size")


@query("S6_keyed_scan_last_wins", "SELECT l_partkey, l_orderkey AS meta_l_orderkey, l_linenumber AS meta_l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)) WHERE rn = 1")
def _(t):
    wanted = t.part.where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return S.metadata_by_key(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", [F.col("l_orderkey").desc(), F.col("l_linenumber").desc()], wanted, "meta_")


@query("S8_columnar_json", "SELECT p_partkey AS row_no, p_name AS name, p_brand AS brand FROM part")
def _(t):
    p = t.part  # a document for each kind of part: name and brand by row number
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), F.col("v"))))
    cols = [p.select("p_type", "p_partkey", F.col(c).alias("v")).groupBy("p_type").agg(pairs.alias("m")).select("p_type", F.lit(n).alias("k"), "m") for n, c in (("name", "p_name"), ("brand", "p_brand"))]
    doc = cols[0].union(cols[1]).groupBy("p_type").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "m")))).alias("text"))
    return S.columnar_json(doc, "text").groupBy("row_no").pivot("column", ["name", "brand"]).agg(F.first("value"))


@query("S9_shuffled_split", "SELECT doc_id FROM documents ORDER BY md5('split-7' || doc_id), doc_id LIMIT 64")
def _(t):
    return t.documents.select("doc_id").orderBy(F.md5(F.concat(F.lit("split-7"), "doc_id")), "doc_id").limit(64)


@query("S11_whitespace_text", "SELECT p_partkey AS id, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM (SELECT *, regexp_replace(p_name, '\\s+', '_', 'g') AS n FROM part) WHERE n = p_name UNION ALL SELECT p_partkey, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) FROM part WHERE p_name LIKE '% %'")
def _(t):
    lines = t.part.select(F.concat(F.lit("  "), "p_partkey", F.lit("\t"), "p_name", F.lit("   "), "p_size", F.lit(" ")).alias("line"))
    return S.delimited_text(lines, "line", ["id", "name", "size"]).select(F.col("id").cast("long").alias("id"), "name", "size")


@query("S12_two_pass_base64", "SELECT p_partkey, p_name AS data FROM part WHERE p_size = 7")
def _(t):
    f = t.part.select("p_partkey", F.base64(F.encode("p_name", "UTF-8")).alias("b"))
    return S.decode_selected(f, "p_partkey", "b", t.part.where("p_size = 7").select("p_partkey")).select("p_partkey", F.decode("data", "UTF-8").alias("data"))


@query("S13_aligned_embeddings", "SELECT vec_id, 'v' || vec_id || '.png' AS path, label FROM embeddings")
def _(t):
    items = t.embeddings.select("vec_id", F.concat(F.lit("v"), "vec_id", F.lit(".png")).alias("path"))
    return S.align_embeddings(t.embeddings.select("vec_id", "label"), items, "vec_id").select("vec_id", "path", "label")


@query("S14_read_through_cache", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def _(t):
    path = folder(t, "cache")
    for _ in range(2):  # computed once, then read
        df = S.read_through(t.spark, path, lambda: t.embeddings.groupBy("label").agg(F.count("*").alias("n")))
    return df


@query("S15_missing_artifacts", "SELECT p_type AS dataset, m AS method FROM (SELECT DISTINCT p_type FROM part), (VALUES ('clip'), ('dino')) v(m) WHERE NOT (p_type = 'ECONOMY' AND m = 'clip')")
def _(t):
    wanted = t.part.select(F.col("p_type").alias("dataset")).distinct().crossJoin(t.spark.createDataFrame([("clip",), ("dino",)], "method string"))
    return S.missing(wanted, t.spark.createDataFrame([("ECONOMY", "clip")], "dataset string, method string"), ["dataset", "method"])


RUNS = "SELECT 'run' || (o_orderkey % 3) AS run_id, o_orderkey, o_orderstatus FROM orders"


def runs(t):
    return t.orders.select(F.concat(F.lit("run"), F.col("o_orderkey") % 3).alias("run_id"), "o_orderkey", "o_orderstatus")


@query("S16_strict_append", f"SELECT run_id, count(*) AS n FROM ({RUNS}) GROUP BY 1")
def _(t):
    path, r = folder(t, "strict"), runs(t)
    for i in (0, 1, 2):
        S.append_strict(r.where(f"run_id = 'run{i}'"), path, r.schema)
    return t.spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"))


@query("S17_migrating_append", f"SELECT run_id, count(*) AS n, count(*) FILTER (WHERE run_id <> 'run0') AS with_status FROM ({RUNS}) GROUP BY 1")
def _(t):
    path, r = folder(t, "migrating"), runs(t)
    S.append_migrating(r.where("run_id = 'run0'").select("run_id", "o_orderkey"), path)
    S.append_migrating(r.where("run_id <> 'run0'"), path)
    return S.read_migrated(t.spark, path).groupBy("run_id").agg(F.count("*").alias("n"), F.count("o_orderstatus").alias("with_status"))


@query("S18_load_run", f"SELECT o_orderkey, o_orderstatus FROM ({RUNS}) WHERE run_id = 'run1'")
def _(t):
    runs(t).write.partitionBy("run_id").parquet(path := folder(t, "runs"))
    return S.load_run(t.spark.read.parquet(path), "run1").select("o_orderkey", "o_orderstatus")


@query("S19_latest_run", "SELECT 'run' || (event_id % 7) AS run_id FROM events ORDER BY ts DESC, 1 DESC LIMIT 1")
def _(t):
    return S.latest_run(t.events.select(F.concat(F.lit("run"), F.col("event_id") % 7).alias("run_id"), F.col("ts").alias("ts_utc")))


@query("S20_json_lines", "SELECT event_id, CAST(user_id AS VARCHAR) AS axis_id, round(value, 4) AS value FROM events WHERE user_id = 7")
def _(t):
    path = folder(t, "snapshots")
    e = t.events.select("event_id", F.col("user_id").cast("string").alias("axis_id"), F.round("value", 4).alias("value"))
    S.json_lines(e.where("event_id % 2 = 0"), path)
    S.json_lines(e.where("event_id % 2 = 1"), path)
    return S.read_json_lines(t.spark, path, "event_id long, axis_id string, value double", "7")


@query("S21_library_order", "SELECT c_name AS name, row_number() OVER (ORDER BY coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 7 % 1000 END, c_custkey) DESC, c_name) AS pos FROM customer")
def _(t):
    c = t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("created"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * 7 % 1000).alias("updated"))
    S.replace_table(c.limit(5), path := folder(t, "library"))
    S.replace_table(c, path)
    from ..operators.ranks import row_numbers

    back = S.library(S.current_table(t.spark, path)).withColumn("k", F.coalesce("updated", "created"))
    return row_numbers(back, "k", "name", "pos", descending=True).select("name", "pos")


@query("S22_activity_log", "SELECT '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] [' || event_type || '] [' || props || ']' AS value FROM events")
def _(t):
    return S.activity_lines(t.events, "ts", "event_type", "props")


@query("S23_json_export", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def _(t):
    return S.to_json_rows(t.nation.select("n_nationkey", "n_name"))


@query("S24_artifact_export")
def _(t):
    axes = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("axis"))
    rec = t.nation.select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("j"), (F.col("n_nationkey") * 7 % 13).alias("score"))
    return t.spark.createDataFrame([(S.artifact(axes, ["1", "2"], rec),)], "artifact string")


@query("S26_library_migration", "SELECT p_type AS name, 'current' AS src FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT DISTINCT p_brand, 'legacy' FROM part")
def _(t):
    cur = t.part.select(F.col("p_type").alias("name")).distinct().withColumn("src", F.lit("current"))
    old = t.part.select(F.col("p_brand").alias("name")).distinct().union(t.part.select(F.lower("p_type")).distinct()).withColumn("src", F.lit("legacy"))
    return S.migrate_library(cur, old, "name")


@query("S27_prediction_log", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('log' || vec_id), vec_id) AS rn FROM embeddings) WHERE rn <= 10")
def _(t):
    return S.limited_log(t.embeddings.select("label", "vec_id"), ["label"], "vec_id", 10, "log")


@query("S28_dataset_inventory", "SELECT source, count(*) AS items, CASE WHEN source = 'src1' THEN 'First source' ELSE 'Dataset ' || source END AS description FROM documents GROUP BY 1")
def _(t):
    return S.inventory(t.documents.select("source"), "source", t.spark.createDataFrame([("src1", "First source")], "source string, description string"))
