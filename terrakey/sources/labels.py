"""Product labels in XML, read with Spark's own xpath functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.functions.text import sensor_name

#: Elements of a label by column, those with numbers, and the corners.
TEXTS = {"product_id": "logical_identifier", "start_time": "start_date_time", "data_type": "data_type"}
NUMBERS = {
    "sun_azimuth": "sun_azimuth", "sun_elevation": "sun_elevation", "solar_incidence": "solar_incidence",
    "pixel_resolution_m": "pixel_resolution", "spacecraft_altitude_km": "spacecraft_altitude",
}
CORNERS = {f"{s}_{axis}": f"{name}_{long}" for s, name in (("ul", "upper_left"), ("ur", "upper_right"), ("ll", "lower_left"), ("lr", "lower_right")) for axis, long in (("lat", "latitude"), ("lon", "longitude"))}
SUFFIXES = [".img", ".IMG", ".qub", ".QUB"]


def first_text(xml: Column, name: str) -> Column:
    """The first text that is not blank of elements with a local name; null if there is none."""
    return _stripped(F.xpath_string(xml, F.lit(f"(//*[local-name()='{name}'][normalize-space()])[1]")))


def _stripped(text: Column) -> Column:
    """Without white space of any kind at either end; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def axis_size(xml: Column, axis: str) -> Column:
    """Elements of the last axis of a name, whatever its case; 0 counts as unknown."""
    path = f"//*[local-name()='Axis_Array'][translate(normalize-space(*[local-name()='axis_name']),'abcdefghijklmnopqrstuvwxyz','ABCDEFGHIJKLMNOPQRSTUVWXYZ')='{axis}']/*[local-name()='elements']/text()"
    found = F.xpath(xml, F.lit(path))
    return F.nullif(F.try_element_at(found, F.lit(-1)).try_cast("int"), F.lit(0))


def parse(labels: DataFrame, xml: str = "content") -> DataFrame:
    """Adds the metadata columns of a label; what is missing or no number is null. Text that is no XML gives an error row's nulls."""
    x = F.col(xml)
    out = labels.withColumns({k: first_text(x, v) for k, v in TEXTS.items()})
    out = out.withColumns({k: first_text(x, v).try_cast("double") for k, v in (NUMBERS | CORNERS).items()})
    out = out.withColumns({"lines": axis_size(x, "LINE"), "samples": axis_size(x, "SAMPLE"), "bands": axis_size(x, "BAND")})
    component = "(//*[local-name()='Observing_System_Component'][translate(normalize-space(*[local-name()='type']),'INSTRUMENT','instrument')='instrument']/*[local-name()='name'][normalize-space()])[1]"
    name = F.coalesce(_stripped(F.xpath_string(x, F.lit(component))), first_text(x, "name"))
    out = out.withColumn("instrument_name", name).withColumns({"sensor": sensor_name(name), "date": F.substring("start_time", 1, 10)})

    def centre(axis: str) -> Column:
        values = F.array_compact(F.array(*(F.col(f"{s}_{axis}") for s in ("ul", "ur", "ll", "lr"))))
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))

    return out.withColumns({"lat_center": centre("lat"), "lon_center": centre("lon")})


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Products under a folder: labels that have a data file of the same stem beside them; previews are left out.

    The label's text is read by Spark, the data files are only listed. Labels without a size in lines and samples are left out.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = every.select("path").withColumn("stem", F.regexp_replace("path", r"\.[A-Za-z]+$", "")).withColumn("ext", F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1))
    order = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.col("ext"))
    data = files.where(F.col("ext").isin(SUFFIXES)).groupBy("stem").agg(F.min_by("path", order).alias("data_path"))
    name = F.element_at(F.split("path", "/"), -1)
    labels = every.where(name.rlike(r"^ch2_.*\.xml$") & ~name.rlike("_b_brw|_g_grd"))
    labels = labels.select("path", F.regexp_replace("path", r"\.xml$", "").alias("stem"), F.decode("content", "UTF-8").alias("content"))
    return parse(labels.join(data, "stem")).where("lines is not null and samples is not null").drop("content")
