"""Queries on stored runs, catalogues and the assistant's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrakey.functions import text as tx
from terrakey.operators.catalogue import latest, merged, one
from terrakey.plans.common import Registry, r, table

query = Registry()


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS top FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 60")
def retention_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 newest runs of each kind stay."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return latest(e, ["event_type"], ["ts", "event_id"], 60).select("event_type", "event_id")


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_id = 42 AND regexp_matches('run_42', '^[A-Za-z0-9_.-]{1,128}$')")
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run by its checked identifier."""
    e = table(spark, sf_dir, "events").withColumn("run", F.concat(F.lit("run_"), F.col("event_id")))
    return one(e, "run", "run_42").select("event_id", "event_type", r("value").alias("value"))


@query("SELECT o_orderkey AS id, o_orderpriority AS family, 'old' AS origin, NULL::DOUBLE AS price FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') UNION ALL SELECT o_orderkey, o_orderpriority, 'new', o_totalprice::DOUBLE FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 2 = 0")
def instance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old instances without the families that are built anew, and the new ones."""
    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("family"), F.lit("old").alias("origin"))
    new = o.where(F.col("o_orderkey") % 2 == 0).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("family"), F.lit("new").alias("origin"), F.col("o_totalprice").cast("double").alias("price"))
    return merged(old, new, "family", ["1-URGENT", "2-HIGH"])


_CRC = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(p_name, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))"


@query(f"SELECT p_name, xor({_CRC}, 4294967295) & 2147483647 AS seed FROM part")
def seed_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeatable seeds of names."""
    return table(spark, sf_dir, "part").select("p_name", (F.crc32(F.col("p_name").cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF))).alias("seed"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six messages of a conversation."""
    return latest(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 6).select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'rmse|accurate|accuracy|error|precision') THEN 'accuracy' WHEN regexp_matches(lower(text), 'inlier|match|keypoint|feature|consensus') THEN 'matches'
  WHEN regexp_matches(lower(text), 'provenance|real|synthetic|derived|simulated') THEN 'provenance' ELSE 'summary' END AS intent FROM conversations""")
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a message asks for."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.intent(F.col("text")).alias("intent"))


_INTENT = "CASE WHEN regexp_matches(lower(text), 'rmse|accurate|accuracy|error|precision') THEN 'accuracy' WHEN regexp_matches(lower(text), 'inlier|match|keypoint|feature|consensus') THEN 'matches' WHEN regexp_matches(lower(text), 'provenance|real|synthetic|derived|simulated') THEN 'provenance' ELSE 'summary' END"
_ASKED = "c.text || CASE c.conv_id % 5 WHEN 0 THEN ' how accurate' WHEN 1 THEN ' which keypoints' WHEN 2 THEN ' simulated' ELSE '' END"


@query(f"""WITH q AS (SELECT conv_id, turn, {_INTENT} AS intent FROM (SELECT conv_id, turn, {_ASKED} AS text FROM conversations c)),
m AS (SELECT q.*, p_partkey IS NOT NULL AS known, 'pair ' || p_partkey AS name, p_size * 0.25::DOUBLE AS rmse, CASE WHEN p_size % 3 > 0 THEN p_size * 0.125::DOUBLE END AS ground, p_size * 0.5::DOUBLE AS med, CASE WHEN p_size % 4 > 0 THEN p_size * 0.75::DOUBLE END AS truth, p_size % 7 = 0 AS degenerate,
p_size * 211 AS ka, p_size * 190 AS kb, p_size * 8 AS nm, p_size * 5 AS ni, p_size * 10 AS ms FROM q LEFT JOIN part ON p_partkey = conv_id AND p_partkey % 6 > 0)
SELECT conv_id, turn, CASE WHEN NOT known THEN 'No run yet, so there are no figures to report.' WHEN intent = 'accuracy' THEN name || ': residual ' || printf('%.3f px', rmse) || CASE WHEN ground IS NULL THEN '' ELSE ' (' || printf('%.3f', ground) || ' m on the ground)' END || ', median ' || printf('%.2f px', med) || '.'
|| CASE WHEN truth IS NULL THEN '' ELSE ' Against the known map it is off by ' || printf('%.2f px', truth) || '; that figure counts.' END || CASE WHEN degenerate THEN ' The fit is degenerate: too few inliers to say much.' ELSE '' END
WHEN intent = 'matches' THEN format('{{:,}}', ka) || ' and ' || format('{{:,}}', kb) || ' keypoints, ' || nm || ' matches, ' || ni || ' inliers (62.5%).' WHEN intent = 'provenance' THEN 'Provenance: made. Only pairs made by a known map have a true error.'
ELSE name || ': ' || ni || ' inliers of ' || nm || ' (62.5%), residual ' || printf('%.3f px', rmse) || CASE WHEN truth IS NULL THEN '' ELSE ', true error ' || printf('%.2f px', truth) END || ', ' || ms || ' ms.' END AS reply FROM m""")
def offline_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said to each message about the run of its conversation, parts standing for runs."""
    size = F.col("p_size")
    figures = {
        "name": F.concat(F.lit("pair "), F.col("p_partkey").cast("string")), "provenance": F.lit("made"), "rmse_px": size * 0.25, "rmse_m": F.when(size % 3 > 0, size * 0.125), "gsd_m": F.lit(0.5), "median_px": size * 0.5,
        "truth_px": F.when(size % 4 > 0, size * 0.75), "degenerate": size % 7 == 0, "n_keypoints_a": size * 211, "n_keypoints_b": size * 190, "n_matches": size * 8, "n_inliers": size * 5, "total_ms": (size * 10).cast("double"),
    }
    part = table(spark, sf_dir, "part").where("p_partkey % 6 > 0")
    c = table(spark, sf_dir, "conversations")
    asked = F.concat("text", F.when(F.col("conv_id") % 5 == 0, " how accurate").when(F.col("conv_id") % 5 == 1, " which keypoints").when(F.col("conv_id") % 5 == 2, " simulated").otherwise(""))
    return c.join(part, c["conv_id"] == part["p_partkey"], "left").select("conv_id", "turn", tx.offline_reply(asked, figures).alias("reply"))


@query(f"""SELECT conv_id, turn, substring(regexp_replace('**`#' || text || chr(9989) || ' *' || chr(9888) || chr(65039) || chr(128202) || ' end', '[*`#{chr(0x2705)}{chr(0x1F4CA)}{chr(0x1F916)}]|{chr(0x26A0)}{chr(0xFE0F)}', '', 'g'), 1, 800) AS speech FROM conversations""")
def voice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with marks and pictographs, as a voice is to say them."""
    marked = F.concat(F.lit("**`#"), "text", F.lit("\u2705 *\u26a0\ufe0f\U0001f4ca end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.voice_text(marked).alias("speech"))


_SAID = """WITH t AS (SELECT event_id, (event_id * 7) % 12 AS k FROM events),
s AS (SELECT event_id, CASE k WHEN 0 THEN 'Run' WHEN 1 THEN ' go  on!' WHEN 2 THEN 'please go forward.' WHEN 3 THEN 'run the next stage' WHEN 4 THEN 'Play?!' WHEN 5 THEN 'runs' WHEN 6 THEN 'go-back' WHEN 7 THEN 'previous' WHEN 8 THEN 'halt. now' WHEN 9 THEN '' WHEN 10 THEN 'stop_it' END AS said FROM t)"""


@query(rf"""{_SAID}, u AS (SELECT *, regexp_replace(lower(trim(said, E' \t\n')), '[.!?]+$', '') AS p FROM s)
SELECT event_id, CASE WHEN len(regexp_split_to_array(p, '\s+')) > 3 THEN NULL WHEN regexp_matches(p, '\b(run|execute|go)\b') THEN 'run' WHEN regexp_matches(p, '\b(next|forward)\b') THEN 'next' WHEN regexp_matches(p, '\b(back|previous)\b') THEN 'back'
  WHEN regexp_matches(p, '\bplay\b') THEN 'play' WHEN regexp_matches(p, '\b(stop|pause|halt)\b') THEN 'stop' END AS command FROM u""")
def command_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command of an utterance, if it is one."""
    said = F.array(*(F.lit(x) for x in ("Run", " go  on!", "please go forward.", "run the next stage", "Play?!", "runs", "go-back", "previous", "halt. now", "", "stop_it")), F.lit(None))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", tx.command(F.get(said, (F.col("event_id") * 7 % 12).cast("int"))).alias("command"))


@query(r"""SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '[*_`#>]', '', 'g'), '\[(.*?)\]\(.*?\)', '\1', 'g'), '[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{0B}]+', ' ', 'g')), 1, 600) AS speech FROM conversations""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean_text(F.col("text")).alias("speech"))


@query("""WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Orbiter High Resolution Imager' WHEN 1 THEN 'TMC-2 nadir' WHEN 2 THEN 'Imaging Infrared' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE p_brand END AS name FROM part)
SELECT id, CASE WHEN coalesce(name, '') = '' THEN 'UNKNOWN' WHEN lower(name) LIKE '%ohrc%' OR lower(name) LIKE '%high resolution%' THEN 'OHRC' WHEN lower(name) LIKE '%tmc%' OR lower(name) LIKE '%terrain mapping%' THEN 'TMC-2' WHEN lower(name) LIKE '%iirs%' OR lower(name) LIKE '%infrared%' THEN 'IIRS' ELSE upper(name) END AS sensor FROM n""")
def sensor_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "Orbiter High Resolution Imager").when(k == 1, "TMC-2 nadir").when(k == 2, "Imaging Infrared").when(k == 3, "").when(k == 5, F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.sensor_name(name).alias("sensor"))


@query("""WITH f AS (SELECT s_suppkey AS id, s_suppkey // 2 AS stem, CASE s_suppkey % 4 WHEN 0 THEN '.QUB' WHEN 1 THEN '.img' WHEN 2 THEN '.IMG' ELSE '.qub' END AS ext FROM supplier)
SELECT stem, arg_min(id, CASE ext WHEN '.img' THEN 0 WHEN '.IMG' THEN 1 WHEN '.qub' THEN 2 ELSE 3 END) AS id, arg_min(ext, CASE ext WHEN '.img' THEN 0 WHEN '.IMG' THEN 1 WHEN '.qub' THEN 2 ELSE 3 END) AS ext FROM f GROUP BY stem""")
def data_file_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the data files of a label, the one whose suffix comes first."""
    k = F.col("s_suppkey")
    ext = F.when(k % 4 == 0, ".QUB").when(k % 4 == 1, ".img").when(k % 4 == 2, ".IMG").otherwise(".qub")
    f = table(spark, sf_dir, "supplier").select(k.alias("id"), F.floor(k / 2).alias("stem"), ext.alias("ext"))
    order = F.when(F.col("ext") == ".img", 0).when(F.col("ext") == ".IMG", 1).when(F.col("ext") == ".qub", 2).otherwise(3)
    return f.groupBy("stem").agg(F.min_by("id", order).alias("id"), F.min_by("ext", order).alias("ext"))


@query("SELECT c_custkey AS id, '/' || replace('figures\\' || c_name, '\\', '/') AS path FROM customer")
def figure_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("figure"), F.concat(F.lit("figures\\"), "c_name")).alias("m"))
    paths = F.transform_values("m", lambda k, v: F.concat(F.lit("/"), F.replace(v, F.lit("\\"), F.lit("/"))))
    return c.select("id", F.try_element_at(paths, F.lit("figure")).alias("path"))


@query("SELECT o_orderkey AS id, abs(o_orderkey % 90 - o_custkey % 90) AS delta_sun, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def sun_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the sun's elevations of a pair, and the day of its start time."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.abs(F.col("o_orderkey") % 90 - F.col("o_custkey") % 90).alias("delta_sun"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("date"))


@query("SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value * 0.7, 6) END AS detect_ms FROM events")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage times from a map; a stage that was not measured is null, never made up."""
    e = table(spark, sf_dir, "events")
    timings = F.map_filter(F.create_map(F.lit("detect"), F.when(F.col("event_id") % 7 != 0, F.col("value") * 0.7), F.lit("match"), F.col("value") * 0.3), lambda k, v: v.isNotNull())
    return e.select("event_id", "event_type", timings.alias("t")).select("event_id", "event_type", r(F.try_element_at("t", F.lit("detect"))).alias("detect_ms"))


@query("""WITH p AS (SELECT l_orderkey AS run, l_linenumber AS i, l_quantity::DOUBLE AS gsd_a, l_discount::DOUBLE * 100 + 1 AS gsd_b, l_partkey % 3000 AS cx, l_suppkey % 3000 AS cy, 800 + l_partkey % 2000 AS n FROM lineitem),
h AS (SELECT *, least(CAST(floor(512 + 600 / gsd_a) AS BIGINT), greatest(64, n // 2 - 2)) AS half_a, least(CAST(floor(greatest(24, 512 * 1.4::DOUBLE / (gsd_b / gsd_a))) AS BIGINT), greatest(24, n // 2 - 2)) AS half_b FROM p)
SELECT run, i, half_a, half_b, greatest(half_a, least(cx, greatest(half_a, n - half_a))) AS safe_x, greatest(16, CAST(round_even(512 * gsd_a / gsd_b, 0) AS BIGINT)) AS final_half_b FROM h""")
def search_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the search and template windows, and the centre moved inside."""
    line = table(spark, sf_dir, "lineitem")
    p = line.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("double").alias("gsd_a"), (F.col("l_discount").cast("double") * 100 + 1).alias("gsd_b"), (F.col("l_partkey") % 3000).alias("cx"), (800 + F.col("l_partkey") % 2000).alias("n"))
    limit = F.floor(F.col("n") / 2) - 2
    half_a = F.least(F.floor(512 + 600 / F.col("gsd_a")), F.greatest(F.lit(64), limit))
    half_b = F.least(F.floor(F.greatest(F.lit(24.0), F.lit(512 * 1.4) / (F.col("gsd_b") / F.col("gsd_a")))), F.greatest(F.lit(24), limit))
    p = p.withColumns({"half_a": half_a, "half_b": half_b})
    safe = F.greatest("half_a", F.least("cx", F.greatest("half_a", F.col("n") - F.col("half_a"))))
    final = F.greatest(F.lit(16).cast("long"), F.bround(512 * F.col("gsd_a") / F.col("gsd_b")).cast("long"))
    return p.select("run", "i", "half_a", "half_b", safe.alias("safe_x"), final.alias("final_half_b"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(roles, ">").alias("roles"))


_WHEN = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@query("""SELECT event_id, '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","user_id":' || user_id || ',"event_type":"' || event_type || '","value":' || value || ',"props":' || to_json(props) || '}' AS json FROM events""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored run as one JSON text, with all its columns."""
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("*"), _WHEN).alias("json"))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role = 'user', turn) AS place FROM conversations""")
def inliers_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawing order: flagged rows last."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("role") == "user", "turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", place.alias("place"))
