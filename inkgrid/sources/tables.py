"""Readers and writers of catalogues, tiles, recipes, jobs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgrid import schema
from inkgrid.functions import names, recipes, sizing
from inkgrid.functions.options import violations, with_defaults
from inkgrid.plans.batch import report_lines
from inkgrid.sources.workspace import in_order

JOB_ROW = "struct<id:long,index:long,image:string,size:string,placement:string,garment:string,status:string,output:string,dpi:double,widthCM:double,heightCM:double,widthPX:int,heightPX:int,error:string>"
JOB_SCHEMA = f"struct<schema:string,version:int,sources:array<struct<name:string,size:long,modified:string>>,rows:array<{JOB_ROW}>>"


def read_catalogue(files: DataFrame) -> DataFrame:
    """ARTWORKS rows of files in a raw raster format: a line `RGBA <width> <height> <dpi>` and then the bytes. files: as spark.read.format("binaryFile") gives them. A
    file that can't be measured is a row with an error. The bytes behind the header are only counted."""
    head = F.decode(F.substring("content", 1, 64), "ISO-8859-1")
    part = lambda i, kind: F.regexp_extract(head, r"^RGBA ([0-9]+) ([0-9]+) ([0-9.]+)\n", i).try_cast(kind)
    rows = files.select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("name"), part(1, "int").alias("width"), part(2, "int").alias("height"), part(3, "double").alias("dpi"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), F.instr(head, "\n").alias("header"))
    error = F.when(F.col("width").isNull() | F.col("height").isNull() | F.col("dpi").isNull(), "unreadable").when(F.col("size_bytes") - F.col("header") != F.col("width").cast("long") * F.col("height") * 4, "truncated")
    return rows.select(F.xxhash64("path").alias("image_id"), "name", "width", "height", "dpi", "size_bytes", "modified", error.alias("error"))


def filter_print_ready(artworks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): art is ready at 300 ppi, half a unit more or less."""
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("dpi").isNull() | (F.abs(F.col("dpi") - sizing.OUTPUT_DPI) > 0.5), "resolution")
    judged = artworks.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def write_tiles(tiles: DataFrame, path: str, parts: int = 64) -> None:
    """Tiles, dealt to so many folders by a hash of the image, each row with length and hash of its bytes: made on the way to the file, so the bytes are looked at once."""
    dealt = tiles.withColumns({"part": F.pmod(F.xxhash64("image_id"), F.lit(parts)).cast("int"), "bytes": F.octet_length("data"), "hash": F.sha2("data", 256)})
    dealt.repartition("part", "tile_y").write.partitionBy("part").parquet(f"{path}/tiles")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Places, lengths and hashes of written tiles. Their bytes stay unread: a column of its own in the files."""
    return spark.read.schema(f"{schema.TILES}, bytes int, hash string, part int").parquet(f"{path}/tiles").drop("data", "part")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schema.TILES}, part int").parquet(f"{path}/tiles").drop("part")


def read_recipes(texts: DataFrame, column: str = "value") -> DataFrame:
    """(id, name, options, areas, profile, error) from JSON collections, one a row. A collection of another schema or version, of more than 100, or of over two million characters, is one error row. A
    recipe is rejected whole, with its error, if it has no name, or an option of a wrong type or outside its range, or odd areas (options and areas are null then); keys that aren't known are dropped. A recipe without an id gets one from its content."""
    v = texts.select(F.try_parse_json(F.when(F.length(column) <= 2_000_000, F.col(column))).alias("c"))
    at = lambda x, k, t: F.try_variant_get(x, f"$.{k}", t)
    version = F.regexp_like(recipes.kind(at(F.col("c"), "version", "variant")), F.lit("^(BIGINT|DECIMAL|DOUBLE)")) & (at(F.col("c"), "version", "double") == 1)
    entries = at(F.col("c"), "recipes", "array<variant>")
    good = F.coalesce((at(F.col("c"), "schema", "string") == "halftone-recipes") & version & (F.size(entries) <= 100), F.lit(False))
    r = v.select(F.explode(F.when(good, entries).otherwise(F.array(F.lit(None).cast("variant")))).alias("r"), good.alias("good"))
    text = lambda x, n: F.substring(F.trim(F.coalesce(x, F.lit(""))), 1, n)
    own = F.col("r")
    profile = F.struct(*(text(at(own, f"profile.{k}", "string"), 120).alias(k) for k in ("brand", "model", "rip", "machine", "material")), F.coalesce(at(own, "profile.calibrated", "boolean") & recipes.kind(at(own, "profile.calibrated", "variant")).startswith("BOOLEAN"), F.lit(False)).alias("calibrated"))
    r = r.select("good", text(at(own, "id", "string"), 80).alias("id"), F.hex(F.xxhash64(F.to_json(own))).alias("hash"), text(at(own, "name", "string"), 80).alias("name"), at(own, "options", "variant").alias("o"), at(own, "areas", "variant").alias("a"), profile.alias("profile"), recipes.kind(own).alias("kind"))
    r = r.withColumn("odd", F.coalesce(recipes.mistyped(F.col("o")), recipes.odd_areas(F.col("a"))))
    sound = lambda c, t: F.when(F.col("odd").isNull() & F.col("good"), F.from_json(F.coalesce(F.to_json(c), F.lit("{}")), t))
    r = r.withColumns({"id": F.when(F.col("good"), F.when(F.col("id") != "", F.col("id")).otherwise(F.concat(F.lit("recipe-"), F.lower("hash")))), "options": sound("o", schema.OPTIONS), "areas": sound("a", schema.AREAS)}).drop("o", "a")
    r = recipes.out_of_range(r, "options").withColumn("odd", F.coalesce("odd", F.concat(F.lit("range: "), F.col("broken"))))
    error = F.when(~F.col("good"), "format").when(~F.coalesce(F.startswith("kind", F.lit("OBJECT")), F.lit(False)), "recipe").when(F.col("name") == "", "no name").otherwise(F.col("odd"))
    fine = lambda c: F.when(F.col("odd").isNull(), F.col(c)).alias(c)
    return r.select("id", "name", fine("options"), fine("areas"), "profile", error.alias("error"))


def write_recipes(rows: DataFrame) -> DataFrame:
    """(value): collections of all rows as JSON, of 100 recipes each (the last has the rest), in the order of their ids."""
    numbered = in_order(rows.select("id", "name", "options", "areas", "profile"), "id").withColumn("n", F.floor(F.col("position") / 100))
    body = numbered.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("position", F.struct("id", "name", "options", "areas", "profile").alias("r"))), lambda a, b: (a["position"] - b["position"]).cast("int")).alias("x"))
    return body.select(F.to_json(F.struct(F.lit("halftone-recipes").alias("schema"), F.lit(1).alias("version"), F.transform("x", lambda e: e["r"]).alias("recipes"))).alias("value"))


def read_job(texts: DataFrame, column: str = "value") -> DataFrame:
    """The rows of job manifests with `problem`: format, id (not dense from 0), index (no such source) or output (not the recomputed name)."""
    j = texts.select(F.from_json(column, JOB_SCHEMA).alias("j"))
    bad = F.coalesce((F.col("j.schema") != "halftone-batch") | (F.col("j.version") != 1), F.lit(True))
    rows = j.select(bad.alias("bad"), F.size("j.sources").alias("n"), F.posexplode_outer("j.rows").alias("pos", "r")).select("bad", "n", "pos", "r.*")
    name = F.concat_ws("/", "size", names.output_name(F.col("index"), F.col("image"), F.col("size"), F.col("placement")))
    problem = F.when(F.col("bad"), "format").when(F.coalesce(F.col("id") != F.col("pos"), F.lit(True)), "id").when(F.coalesce(~F.col("index").between(0, F.col("n") - 1), F.lit(True)), "index").when(F.coalesce(F.col("output") != name, F.lit(True)), "output")
    return rows.withColumn("problem", problem).drop("bad", "n", "pos")


def write_report_csv(rows: DataFrame, path: str, most: int = 100_000) -> DataFrame:
    """The report as text: a header with a byte order mark, then the rows in the order of their ids; lines end as Windows has them. Written in parts of some `most` lines, sorted by ranges of ids; the parts, one after the other, are the file.

    Returns (and writes beside them) the parts' manifest: part, name, lines (the header is one), bytes, offset of the first byte, and SHA-256 of the bytes."""
    header = "\ufeff" + ",".join(names.REPORT_FIELDS)
    lines = report_lines(rows).select(F.lit(1).alias("n"), "id", F.col("line").alias("value"))
    all_ = rows.sparkSession.createDataFrame([(0, None, header)], "n int, id long, value string").unionByName(lines)
    all_.repartitionByRange(-(-(rows.count() + 1) // most), "n", "id").sortWithinPartitions("n", "id", "value").select("value").write.option("lineSep", "\r\n").text(path)
    files = rows.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.decode("content", "ISO-8859-1")
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2
    parts = files.select(F.regexp_extract(name, "^part-([0-9]+)", 1).cast("int").alias("part"), name.alias("name"), lines.cast("long").alias("lines"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"))
    before = F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")  # of parts: a few
    parts.withColumn("offset", before).coalesce(1).write.parquet(f"{path}/_manifest")
    return rows.sparkSession.read.parquet(f"{path}/_manifest")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the written lines by their number in the whole report, the header being 0. A cell may have line breaks of its own (bare ones)."""
    whole = F.decode("content", "UTF-8")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.substring(whole, 1, F.length(whole) - 2).alias("text"))  # without the last line's end
    up = F.sum("lines").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("lines")
    bases = spark.read.parquet(f"{path}/_manifest").withColumn("base", up).select("name", "base")
    each = files.join(bases, "name").select("base", F.posexplode(F.split("text", "\r\n")).alias("pos", "value"))  # a part is cut once, not for each of its lines
    return each.select((F.col("base") + F.col("pos")).alias("line"), "value")


def write_report_json(rows: DataFrame, path: str) -> None:
    """All rows as JSON, and a summary beside them."""
    from inkgrid.plans.batch import batch_summary

    rows.write.json(f"{path}/rows")
    batch_summary(rows).write.json(f"{path}/summary")


def write_outputs(tiles: DataFrame, variants: DataFrame, path: str) -> None:
    """Output tiles laid out by garment size. variants: (id, size)."""
    tiles.join(variants.select(F.col("id").alias("image_id"), "size").hint("shuffle_hash"), "image_id").write.partitionBy("size").parquet(path)


def check_recipes(rows: DataFrame) -> DataFrame:
    """(recipe_id, violations)."""
    return with_defaults(rows).select("recipe_id", violations().alias("violations"))
