"""Registered queries of readers and writers: a table is written as files of a format to a shared work folder and read back."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from ..functions import jsons
from ..operators.work import work_dir
from ..sources import files, formats
from ..streaming import events as stream
from .queries import query
from .session import table

C = F.col


def _back(spark, df, handler: str, parts: int = 2):
    """df written in a format and read again."""
    path = work_dir(spark)
    files.write(df.repartition(parts), path, handler)
    return files.read(spark, path, handler, glob="part-*")


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


def _dealt(df):
    """df over all cores: a small file of many rows is read by one task."""
    return df.repartition(max(8, df.sparkSession.sparkContext.defaultParallelism), "p_partkey")


_PART = "SELECT p_partkey, p_name, p_size::BIGINT p_size, p_retailprice FROM part"


def _row(df):
    """The columns of a part from a row as JSON."""
    j = C("row")
    return df.select(jsons.get(j, "p_partkey", "long").alias("p_partkey"), jsons.get(j, "p_name").alias("p_name"), jsons.get(j, "p_size", "long").alias("p_size"), jsons.get(j, "p_retailprice", "double").alias("p_retailprice"))


@query(_PART)
def files_json(spark, d):
    return _row(_back(spark, _parts(spark, d), "json"))


@query(_PART)
def files_bson(spark, d):
    return _row(_back(spark, _parts(spark, d), "bson"))


@query(_PART)
def files_yaml(spark, d):
    return _row(_back(spark, _parts(spark, d), "yaml"))


@query(_PART)
def files_plist(spark, d):
    whole = _back(spark, _parts(spark, d), "plist")  # a list is one value
    return _row(whole.select(F.explode(F.from_json("row", "array<string>")).alias("row")))


@query(_PART)
def files_sqlite(spark, d):
    return _row(_back(spark, _parts(spark, d), "sqlite").where("`table` = 'rows'"))


@query("SELECT p_partkey \"key\", p_name \"name\", p_size::BIGINT size, p_retailprice price FROM part")
def files_dbase(spark, d):
    got = _back(spark, _parts(spark, d).toDF("key", "name", "size", "price"), "dbf")
    j = C("row")
    return got.select(jsons.get(j, "key", "long").alias("key"), jsons.get(j, "name").alias("name"), jsons.get(j, "size", "long").alias("size"), jsons.get(j, "price", "double").alias("price"))


@query("SELECT n_name, count(*) n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def files_xml(spark, d):
    """Counted by elements of the documents."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), C("c_nationkey") == C("n_nationkey")).select("c_name", "n_name")
    return _back(spark, c, "xml").where("path = 'rows/row/n_name'").groupBy(C("text").alias("n_name")).agg(F.count("*").alias("n"))


def _cells(df, names: list[str]):
    """Rows of a sheet from its cells, below the names; a null cell is absent."""
    found = df.where("row > 0").groupBy("file", "row").pivot("col", list(range(len(names)))).agg(F.first(F.coalesce("text", C("number").cast("string"))))
    return found.select(*[C(str(i)).alias(n) for i, n in enumerate(names)])


def _sheet(spark, d, handler):
    path = work_dir(spark)
    files.write(table(spark, d, "nation").select("n_name", "n_nationkey").repartition(2), path, handler)
    got = _cells(files.read(spark, path, handler, glob="part-*", with_path=True), ["n_name", "key"])
    return got.select("n_name", C("key").cast("double").cast("long").alias("key"))


@query("SELECT n_name, n_nationkey::BIGINT \"key\" FROM nation")
def files_xlsx(spark, d):
    return _sheet(spark, d, "xlsx")


@query("SELECT n_name, n_nationkey::BIGINT \"key\" FROM nation")
def files_ods(spark, d):
    return _sheet(spark, d, "ods")


@query("SELECT p_partkey, p_retailprice FROM part")
def files_matlab(spark, d):
    """Two variables for each file, as many files as the rows need."""
    path = work_dir(spark)
    files.write(table(spark, d, "part").select(C("p_partkey").cast("double").alias("k"), "p_retailprice").repartition(2), path, "matlab")
    got = files.read(spark, path, "matlab", glob="part-*", with_path=True)
    values = F.from_json(F.get_json_object("value", "$.values"), "array<double>")
    v = got.groupBy("file").agg(F.max(F.when(C("name") == "k", values)).alias("k"), F.max(F.when(C("name") == "p_retailprice", values)).alias("v"))
    return v.select(F.explode(F.arrays_zip("k", "v")).alias("x")).select(C("x.k").cast("long").alias("p_partkey"), C("x.v").alias("p_retailprice"))


@query("SELECT n_name \"value\", 'INDI/NAME' path FROM nation")
def files_gedcom(spark, d):
    n = table(spark, d, "nation")
    lines = F.array(F.struct(F.lit(0).alias("level"), F.concat(F.lit("@N"), "n_nationkey", F.lit("@")).alias("id"), F.lit("INDI").alias("tag"), F.lit(None).cast("string").alias("value")), F.struct(F.lit(1).alias("level"), F.lit(None).cast("string").alias("id"), F.lit("NAME").alias("tag"), C("n_name").alias("value")))
    path = work_dir(spark)
    files.write(n.repartition(2).select(F.explode(lines).alias("l")).select("l.*"), path, "gedcom")
    return files.read(spark, path, "gedcom", glob="part-*").where("tag = 'NAME'").select("value", "path")


def _members(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("n/"), "n_nationkey", F.lit(".txt")).alias("name"), C("n_name").cast("binary").alias("content"))


_MEMBERS = "SELECT 'n/' || n_nationkey || '.txt' \"name\", length(n_name)::BIGINT size, n_name content FROM nation"


@query(_MEMBERS)
def files_zip(spark, d):
    return _back(spark, _members(spark, d), "zip").select("name", "size", C("content").cast("string").alias("content"))


@query(_MEMBERS)
def files_tar(spark, d):
    return _back(spark, _members(spark, d), "tar").select("name", "size", C("content").cast("string").alias("content"))


@query("SELECT s_nationkey \"row\", s_suppkey::INT % 7 col, max(s_acctbal) \"value\" FROM supplier GROUP BY 1, 2")
def files_grid(spark, d):
    """An ASCII grid; cells without a value are absent."""
    s = table(spark, d, "supplier").groupBy(C("s_nationkey").alias("row"), (C("s_suppkey") % 7).cast("int").alias("col")).agg(F.max("s_acctbal").alias("value"))
    return _back(spark, s.coalesce(1), "grid", 1).select("row", "col", "value")


@query("SELECT count(*) n, round(avg(v), 6) mean, round(stddev_samp(v), 6) sigma, min(v) lo, max(v) hi FROM (SELECT max(s_acctbal) v FROM supplier GROUP BY s_nationkey, s_suppkey % 7)")
def raster_statistics(spark, d):
    """Statistics of a raster, cells without data left out."""
    g = files_grid(spark, d)
    return g.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sigma"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("SELECT c_custkey::DOUBLE x, c_acctbal y, 'point' \"type\" FROM customer")
def files_shapes(spark, d):
    c = table(spark, d, "customer").select(C("c_custkey").cast("double").alias("x"), C("c_acctbal").alias("y"))
    return _back(spark, c, "shapefile").where("type = 'point'").select(C("points")[0][0].alias("x"), C("points")[0][1].alias("y"), "type")


@query("SELECT n_name \"text\", 'td' \"name\", count(*) n FROM nation GROUP BY 1")
def files_html(spark, d):
    return _back(spark, table(spark, d, "nation").select("n_name"), "html").where("name = 'td'").groupBy("text", "name").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::VARCHAR id, n_name || ' é' \"text\" FROM nation")
def files_text(spark, d):
    """Texts with byte-order marks of three kinds, as files by their own mark."""
    mark = {0: (b"\xef\xbb\xbf", "UTF-8"), 1: (b"\xff\xfe", "UTF-16LE"), 2: (b"\xfe\xff", "UTF-16BE")}
    t = F.concat("n_name", F.lit(" é"))
    made = F.lit(None).cast("binary")
    for k, (head, charset) in mark.items():
        made = F.when(C("n_nationkey") % 3 == k, F.concat(F.lit(bytearray(head)), F.encode(t, charset))).otherwise(made)
    held = table(spark, d, "nation").select(C("n_nationkey").cast("string").alias("id"), made.alias("content"))
    return held.select("id", files.text_of(C("content")).alias("text"))


@query("SELECT event_id, epoch_us(ts) micros, length(props)::INT length, props FROM events")
def packets(spark, d):
    """Events as captured packets."""

    def capture(batches):
        for b in batches:
            made = [struct.pack("<IIII", t // 1_000_000, t % 1_000_000, len(x) + 8, len(x) + 8) + struct.pack("<q", i) + x for i, t, x in zip(b.event_id, b.t, (p.encode() for p in b.props), strict=True)]
            yield pd.DataFrame({"path": ["p"], "content": [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(made)]})

    e = table(spark, d, "events").select("event_id", F.unix_micros(C("ts").cast("timestamp")).alias("t"), "props")
    got = files.parse_files(e.mapInPandas(capture, "path string, content binary"), "pcap")
    swapped = F.concat(*[F.substring(F.hex(F.substring("bytes", 1, 8)), 15 - 2 * i, 2) for i in range(8)])
    return got.select(F.conv(swapped, 16, 10).cast("long").alias("event_id"), "micros", (C("length") - 8).alias("length"), F.substring("bytes", 9, 1 << 20).cast("string").alias("props"))


@query("SELECT p_partkey::BIGINT \"key\", p_name \"name\" FROM part")
def protobuf_fields(spark, d):
    """Messages of a number and a text, by their wire fields."""

    def number(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(batches):
        for b in batches:
            yield pd.DataFrame({"path": [str(k) for k in b.p_partkey], "content": [b"\x08" + number(k) + b"\x12" + number(len(t)) + t for k, t in zip(b.p_partkey, (x.encode() for x in b.p_name), strict=True)]})

    got = files.parse_files(_dealt(table(spark, d, "part").select("p_partkey", "p_name")).mapInPandas(message, "path string, content binary"), "protobuf", with_path=True)
    key, name = F.max(F.when(C("path") == "/1", C("number"))), F.max(F.when(C("path") == "/2", C("bytes").cast("string")))
    return got.groupBy("file").agg(key.alias("key"), name.alias("name")).select("key", "name")


@query("SELECT n_nationkey::VARCHAR id, n_name FROM nation")
def listing_written(spark, d):
    """A listing as CSV with a header, found again by its glob."""
    path = work_dir(spark)
    files.write_listing(table(spark, d, "nation").select(C("n_nationkey").alias("id"), "n_name"), path)
    if not files.find_files(spark, path, "*.csv").count():
        raise ValueError("no listing was found")
    return spark.read.option("header", True).csv(path).select("id", "n_name")


_FLAT = [("key", "long"), ("name", "string"), ("size", "int"), ("price", "double"), ("gone", "int"), ("tags", "[string]"), ("inner", [("low", "short"), ("high", "short")])]


def _flat_part(key: int, name: str, size: int, price: float) -> bytes:
    """One part in the FlatBuffers layout: root offset, table behind its field offsets, texts and the table inside at the end."""
    text = lambda t: struct.pack("<I", len(t)) + t + bytes(4 - len(t) % 4)
    offsets = struct.pack("<9H", 18, 44, 8, 16, 4, 20, 0, 28, 32)  # ids 0 to 6; id 4 is missing
    table = 4 + len(offsets) + 2
    tail, at = b"", table + 44
    places = []
    for made in (text(name.encode()), struct.pack("<I", 1) + struct.pack("<I", 4) + text(b"x"), struct.pack("<4H", 8, 8, 4, 6) + struct.pack("<i", 8) + struct.pack("<2h", size % 7, size % 11)):
        places.append(at + len(tail) + (8 if len(places) == 2 else 0))
        tail += made
    body = struct.pack("<ii", table - 4, size) + struct.pack("<q", key) + struct.pack("<I", places[0] - table - 16) + struct.pack("<d", price) + struct.pack("<II", places[1] - table - 28, places[2] - table - 32) + bytes(8)
    return struct.pack("<I", table) + offsets + bytes(2) + body + tail


formats.flatbuffers("flat_part", _FLAT)


@query("SELECT p_partkey \"key\", p_name \"name\", p_size::BIGINT size, p_retailprice price, 'x' tag, (p_size % 7)::BIGINT low, (p_size % 11)::BIGINT high, true gone FROM part")
def flatbuffer_parts(spark, d):
    """Tables with scalars, texts, vectors, a table inside and a field that is missing."""

    def made(batches):
        for b in batches:
            yield pd.DataFrame({"path": ["p"] * len(b), "content": [_flat_part(*r) for r in b.itertuples(index=False, name=None)]})

    got = files.parse_files(_dealt(_parts(spark, d)).mapInPandas(made, "path string, content binary"), "flat_part")
    j, v = C("row"), jsons.get
    return got.select(v(j, "key", "long").alias("key"), v(j, "name").alias("name"), v(j, "size", "long").alias("size"), v(j, "price", "double").alias("price"), v(j, "tags/0").alias("tag"), v(j, "inner/low", "long").alias("low"), v(j, "inner/high", "long").alias("high"), v(j, "gone").isNull().alias("gone"))


@query("SELECT 'n' || n_nationkey \"name\", 'xs:string' \"type\", 0 least, n_regionkey::INT + 1 most, 'element' kind FROM nation")
def schema_declarations(spark, d):
    """An XML schema with an element for each nation."""

    def schema(batches):
        for b in batches:
            made = "".join(f'<xs:element name="n{k}" type="xs:string" minOccurs="0" maxOccurs="{r + 1}"/>' for k, r in zip(b.n_nationkey, b.n_regionkey, strict=True))
            yield pd.DataFrame({"path": ["s"], "content": [f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="all"><xs:complexType><xs:sequence>{made}</xs:sequence></xs:complexType></xs:element></xs:schema>'.encode()]})

    got = files.parse_files(table(spark, d, "nation").select("n_nationkey", "n_regionkey").mapInPandas(schema, "path string, content binary"), "xsd")
    return got.where("depth = 2").select("name", "type", "least", "most", "kind")


@query("""SELECT CASE n_nationkey % 4 WHEN 1 THEN 'modify' WHEN 2 THEN 'rename' ELSE 'remove' END op, 'f' || n_nationkey || CASE n_nationkey % 4 WHEN 2 THEN '.new' ELSE '' END path, CASE n_nationkey % 4 WHEN 2 THEN 'f' || n_nationkey END old_path
FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT 'add', 'g' || r_regionkey, NULL FROM region""")
def folder_changes(spark, d):
    """Two listings of a folder: files kept, changed, renamed, removed and added."""
    n, k = table(spark, d, "nation"), C("n_nationkey")
    before = n.select(F.concat(F.lit("f"), k).alias("path"), (k * 10).cast("long").alias("length"), F.timestamp_seconds(k).alias("modified"))
    kept = n.where(k % 4 != 3).select(F.concat(F.lit("f"), k, F.when(k % 4 == 2, ".new").otherwise("")).alias("path"), (k * 10 + F.when(k % 4 == 1, 1).otherwise(0)).cast("long").alias("length"), F.timestamp_seconds(k).alias("modified"))
    new = table(spark, d, "region").select(F.concat(F.lit("g"), "r_regionkey").alias("path"), (C("r_regionkey") * 1000 + 7).cast("long").alias("length"), F.timestamp_seconds(C("r_regionkey") + 99).alias("modified"))
    return stream.changes(before, kept.unionByName(new))


def _stream(spark, d):
    """The events as a stream of three files."""
    path = work_dir(spark)
    e = table(spark, d, "events").withColumn("ts", C("ts").cast("timestamp"))
    e.repartition(3).write.parquet(path)
    return stream.watch(spark, path, e.schema, files_per_trigger=1)


def _run(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) \"start\", event_type, count(*) n, round(sum(value), 3) total FROM events GROUP BY 1, 2")
def streamed_windows(spark, d):
    """Windows over a stream, as they stand at its end."""
    out = work_dir(spark)
    got = stream.tumbling(_stream(spark, d), "ts", "1 day", ["event_type"], late="3650 days", n=F.count("*"), total=F.round(F.sum("value"), 3))
    _run(got.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/at{i:06d}")).option("checkpointLocation", work_dir(spark)))
    last = spark.read.option("recursiveFileLookup", "true").schema("start timestamp, end timestamp, event_type string, n long, total double").parquet(out).withColumn("at", F.regexp_extract(F.input_file_name(), r"/at(\d+)/", 1))
    ends = F.broadcast(last.agg(F.max("at").alias("last")))  # one row
    return last.join(ends, C("at") == C("last")).select("start", "event_type", "n", "total")


@query("SELECT 'low' sink, count(*) n FROM events UNION ALL SELECT 'high', count(*) FROM events WHERE event_type = 'error'")
def streamed_fan_out(spark, d):
    """Every batch goes to two sinks, the more urgent one first."""
    out = work_dir(spark)

    def sink(name, keep):
        return lambda b, i: b.where(keep).select(F.lit(name).alias("sink"), "event_id").write.mode("append").parquet(f"{out}/{name}")

    _run(stream.fan_out(_stream(spark, d), [(1, sink("low", "true")), (5, sink("high", "event_type = 'error'"))], work_dir(spark)))
    return spark.read.option("recursiveFileLookup", "true").schema("sink string, event_id long").parquet(out).groupBy("sink").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) n FROM events GROUP BY 1")
def streamed_states(spark, d):
    """A filter's state for each user over a stream: one estimate for each event."""
    out = work_dir(spark)
    got = stream.kalman(_stream(spark, d), "user_id", "ts", "value", 1.0, 25.0)
    _run(got.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", work_dir(spark)))
    back = spark.read.schema(got.schema).parquet(out)
    return back.where("variance > 0 AND variance <= 25").groupBy("user_id").agg(F.count("estimate").alias("n"))
