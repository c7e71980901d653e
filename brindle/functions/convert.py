"""Named operations and conversions: a registry, coercions between types, and structural conversion by field name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, dates, hashes, strings


class Registry:
    """Operations by name, and conversions by source and target type."""

    def __init__(self) -> None:
        self.operations: dict[str, Callable[..., Column]] = {}
        self.conversions: dict[tuple[str, str], Callable[[Column], Column]] = {}

    def operation(self, name: str, f: Callable[..., Column]) -> None:
        self.operations[name] = f

    def conversion(self, source: str, target: str, f: Callable[[Column], Column]) -> None:
        self.conversions[source, target] = f

    def apply(self, name: str, *args) -> Column:
        return self.operations[name](*args)

    def convert(self, c: Column, source: str, target: str, limit: int = 64) -> Column:
        """c converted along the shortest chain of conversions; itself where the types are equal."""
        if source == target:
            return c
        paths: dict[str, list[tuple[str, str]]] = {source: []}
        front = [source]
        for _ in range(limit):
            nxt = []
            for at in front:
                for (a, b), _f in self.conversions.items():
                    if a == at and b not in paths:
                        paths[b] = [*paths[at], (a, b)]
                        nxt.append(b)
            if target in paths or not nxt:
                break
            front = nxt
        if target not in paths:
            raise KeyError(f"no conversion from {source} to {target}")
        for step in paths[target]:
            c = self.conversions[step](c)
        return c

    def register_udf(self, spark: SparkSession, name: str, udf) -> None:
        """Make a Python UDF known to SQL, and to apply()."""
        spark.udf.register(name, udf)
        self.operations[name] = lambda *a: F.call_function(name, *a)


def default_registry() -> Registry:
    r = Registry()
    r.operation("SubArray", arrays.sub_array)
    r.operation("UniqueArray", arrays.unique_array)
    r.operation("AppendArray", arrays.append_array)
    r.operation("RepeatByte", lambda c, n: F.repeat(c, n))
    r.operation("Permutations", arrays.permutations)
    r.operation("Gaussian", arrays.gaussian)
    r.operation("MakeSineWave", arrays.sine_wave)
    r.operation("GetChannel", arrays.channel)
    r.operation("Convolve", arrays.convolve)
    r.operation("Average", arrays.moving_mean)
    r.operation("SoftMax", arrays.soft_max)
    r.operation("LogSoftMax", lambda a, beta=1.0: arrays.soft_max(a, beta, True))
    r.operation("Resample", arrays.resample)
    r.operation("DecodeBase64", hashes.from_base64)
    r.operation("HashMD5", hashes.md5)
    r.operation("AESencrypt", hashes.encrypt)
    r.operation("AESdecrypt", hashes.decrypt)
    r.operation("Dos2Unix", lambda c: F.replace(c, F.lit("\r"), F.lit("")))
    r.operation("Unix2Dos", lambda c: F.replace(c, F.lit("\n"), F.lit("\r\n")))
    r.operation("EmbedAs", lambda c, how="json": {"json": F.to_json, "csv": F.to_csv, "xml": F.to_xml}[how](c))
    r.operation("LoadAs", lambda c, schema, how="json": {"json": F.from_json, "csv": F.from_csv, "xml": F.from_xml}[how](c, schema))
    r.operation("WildCard", strings.glob_match)
    r.conversion("string", "crc32", hashes.crc32)
    r.conversion("binary", "crc32", hashes.crc32)
    r.conversion("long", "boolean", lambda c: c != 0)
    r.conversion("double", "long", lambda c: c.cast("long"))
    r.conversion("boolean", "string", lambda c: c.cast("string"))
    r.conversion("string", "guid", strings.parse_guid)
    r.conversion("date", "timestamp", lambda c: c.cast("timestamp"))
    r.conversion("timestamp", "micros", dates.micros)
    r.conversion("timestamp", "filetime", dates.to_filetime)
    r.conversion("filetime", "timestamp", dates.from_filetime)
    r.conversion("string", "long", strings.parse_int)
    r.conversion("string", "double", strings.parse_float)
    r.conversion("string", "boolean", strings.parse_bool)
    r.conversion("long", "double", lambda c: c.cast("double"))
    r.conversion("long", "string", lambda c: c.cast("string"))
    r.conversion("double", "string", lambda c: c.cast("string"))
    r.conversion("boolean", "long", lambda c: c.cast("long"))
    r.conversion("string", "binary", lambda c: F.encode(c, "UTF-8"))
    r.conversion("binary", "string", lambda c: F.decode(c, "UTF-8"))
    return r


def structural(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """c in a target type: structs field by field by name (missing ones null), arrays and maps by element, scalars by cast that gives null where it fails."""
    if source == target:
        return c
    if isinstance(target, T.StructType) and isinstance(source, T.StructType):
        have = {f.name: f.dataType for f in source.fields}
        fields = [(structural(c.getField(f.name), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(target, T.ArrayType) and isinstance(source, T.ArrayType):
        return F.transform(c, lambda x: structural(x, source.elementType, target.elementType))
    if isinstance(target, T.ArrayType):
        return F.array(structural(c, source, target.elementType))
    if isinstance(target, T.MapType) and isinstance(source, T.MapType):
        return F.transform_values(c, lambda _, v: structural(v, source.valueType, target.valueType))
    return c.try_cast(target)
