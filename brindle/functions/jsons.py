"""JSON texts: paths, listing, ordering, patches and a schema subset as one Boolean column."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .strings import quote


def to_path(path: str) -> str:
    """A path like a/b/0 as $['b'][0]; empty parts are skipped."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("/") if p)


def get(c: Column, path: str, kind: str = "string") -> Column:
    """The value at a path, cast to a type; null if it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(c), to_path(path), kind)


def length(c: Column) -> Column:
    """Elements of an array or members of an object; 0 for anything else."""
    return F.coalesce(F.json_array_length(c), F.size(F.json_object_keys(c)), F.lit(0))


def parse(c: Column) -> Column:
    return F.try_parse_json(c)


def serialise(c: Column) -> Column:
    return F.to_json(c)


def items(df: DataFrame, column: str) -> DataFrame:
    """df with a row for each member of the JSON in a column: pos, key, value."""
    v = df.withColumn("__v", F.try_parse_json(column))
    return v.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer())).drop("__v")


@F.pandas_udf(T.StringType())
def set_value(c: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    """The JSON with the value (itself JSON) put at a path; missing objects on the way are made, arrays grow by one at most."""

    def one(text, p, new):
        try:
            root, new = json.loads(text) if text else {}, json.loads(new)
        except (TypeError, ValueError):
            return None
        parts = [x for x in p.split("/") if x]
        if not parts:
            return json.dumps(new, ensure_ascii=False, separators=(",", ":"))
        at = root
        for k, x in enumerate(parts):
            final = k == len(parts) - 1
            if isinstance(at, list):
                if not x.isdigit() or int(x) > len(at):
                    return None
                if int(x) == len(at):
                    at.append({})
                x = int(x)
            elif not isinstance(at, dict):
                return None
            if final:
                at[x] = new
            elif isinstance(at, dict):
                at = at.setdefault(x, {})
            else:
                at = at[x]
        return json.dumps(root, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(*x) for x in zip(c, path, value, strict=True)], dtype="object")


#: Order of kinds when JSON values of different kinds are compared (fixed values).
KINDS = ["null", "boolean", "number", "string", "array", "object"]


def kind(c: Column) -> Column:
    """null, boolean, number, string, array or object; null if the text is no JSON."""
    t = F.schema_of_variant(F.try_parse_json(c))
    return F.when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when(t.isNotNull(), "number")


def order_key(c: Column) -> Column:
    """A struct that sorts JSON scalars: by kind, then by value, whole and fractional numbers alike."""
    v = F.try_parse_json(c)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind(c))
    return F.struct(rank.alias("kind"), F.try_variant_get(v, "$", "double").alias("number"), F.try_variant_get(v, "$", "string").alias("text"))


def patch(op: str, path: str, value: Column | None = None) -> Column:
    """One JSON Patch entry: add, replace or remove."""
    return F.struct(F.lit(op).alias("op"), F.lit("/" + "/".join(x for x in path.split("/") if x)).alias("path"), (value.cast("string") if value is not None else F.lit(None).cast("string")).alias("value"))


def valid(c: Column, schema: dict | bool) -> Column:
    """Whether a JSON text fits a draft-7 schema. A null or broken text does not fit; unknown keywords raise.

    The schema becomes one expression; $ref to a part of the schema is put in its
    place. Only a schema that refers to itself is checked value by value, an
    Arrow batch at a time.
    """
    _known(schema)
    try:
        v = F.try_parse_json(c)
        return F.coalesce(v.isNotNull() & _fits(v, "$", schema, schema, ()), F.lit(False))
    except RecursionError:
        return _checker(json.dumps(schema))(c)


_ANNOTATIONS = {"$schema", "$id", "title", "description", "default", "examples", "$comment", "readOnly", "writeOnly", "contentEncoding", "contentMediaType"}
_SCHEMAS = {"not", "if", "then", "else", "contains", "additionalProperties", "additionalItems", "propertyNames", "items"}
_LISTS, _MAPS = {"allOf", "anyOf", "oneOf", "items"}, {"properties", "patternProperties", "definitions", "dependencies"}
_OTHERS = {"type", "const", "enum", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "required", "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties", "$ref"}


def _known(s) -> None:
    """Raise for a keyword that draft-7 does not have."""
    if not isinstance(s, dict):
        return
    if extra := set(s) - _ANNOTATIONS - _SCHEMAS - _LISTS - _MAPS - _OTHERS:
        raise ValueError(f"unknown keywords: {sorted(extra)}")
    for k, x in s.items():
        if k in _SCHEMAS:
            _known(x)
        if k in _LISTS and isinstance(x, list):
            for y in x:
                _known(y)
        if k in _MAPS:
            for y in x.values():
                _known(y)


def _target(root, ref: str):
    """The part of a schema that a reference like #/definitions/a names."""
    if not ref.startswith("#"):
        raise ValueError(f"only references into the schema itself are followed: {ref}")
    at = root
    for part in ref[1:].split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~").replace("%25", "%").replace("%22", '"')
        at = at[int(part)] if isinstance(at, list) else at[part]
    return at


_HOST = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)(?:\.(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?))*"
_FOUR = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_SIX = r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)"
#: Formats whose texts a pattern describes.
FORMATS = {
    "email": r"[^@\s]+@" + _HOST, "idn-email": r"[^@\s]+@[^@\s]+", "hostname": _HOST, "ipv4": _FOUR, "ipv6": _SIX, "uri": r"[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*", "uri-reference": r"[^\s<>\"{}|\\^`]*",
    "uuid": r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", "json-pointer": r"(?:/(?:[^~/]|~[01])*)*", "relative-json-pointer": r"(?:0|[1-9]\d*)(?:#|(?:/(?:[^~/]|~[01])*)*)",
}
_DAY = r"(?:\d{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12]\d|3[01])|(?:0[469]|11)-(?:0[1-9]|[12]\d|30)|02-(?:0[1-9]|1\d|2[0-8]))|(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29)"
_CLOCK = r"(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)"
FORMATS |= {"date": _DAY, "time": _CLOCK, "date-time": rf"{_DAY}[Tt]{_CLOCK}"}


def _kind_of(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return F.when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when(t.isNotNull(), "number")


def _as_json(text: Column) -> Column:
    """A text as a JSON value."""
    return F.try_variant_get(F.try_parse_json(F.to_json(F.struct(text.alias("k")))), "$.k", "variant")


def _fits(v: Column, path: str, s: dict | bool, root, way: tuple) -> Column:
    if isinstance(s, bool):
        return F.lit(s)
    if "$ref" in s:  # what stands beside it does not count
        if s["$ref"] in way:
            raise RecursionError(s["$ref"])
        return _fits(v, path, _target(root, s["$ref"]), root, (*way, s["$ref"]))
    here = v if path == "$" else F.try_variant_get(v, path, "variant")
    t = _kind_of(here)
    number, text = F.try_variant_get(v, path, "double"), F.try_variant_get(v, path, "string")
    tests: list[Column] = []

    def fits(c: Column, sub, at: str = "$") -> Column:
        return F.coalesce(_fits(c, at, sub, root, way), F.lit(False))

    def when(k: str, c: Column) -> None:
        tests.append((t != k) | F.coalesce(c, F.lit(False)))

    def some(cs: list[Column]) -> Column:
        out = F.lit(False)
        for c in cs:
            out = out | F.coalesce(c, F.lit(False))
        return out

    def equals(value) -> Column:
        if value is None:
            return t == "null"
        if isinstance(value, bool):
            return (t == "boolean") & (F.try_variant_get(v, path, "boolean") == value)
        if isinstance(value, (int, float)):
            return (t == "number") & (number == float(value))
        if isinstance(value, str):
            return (t == "string") & (text == value)
        return F.to_json(here) == F.to_json(F.parse_json(F.lit(json.dumps(value))))

    if "type" in s:
        kinds = s["type"] if isinstance(s["type"], list) else [s["type"]]
        tests.append(some([(t == "number") & (number == F.floor(number)) if k == "integer" else t == k for k in kinds]))
    if "const" in s:
        tests.append(some([equals(s["const"])]))
    if "enum" in s:
        tests.append(some([equals(x) for x in s["enum"]]))
    for k, test in (("minimum", lambda b: number >= b), ("maximum", lambda b: number <= b), ("exclusiveMinimum", lambda b: number > b), ("exclusiveMaximum", lambda b: number < b), ("multipleOf", lambda b: F.abs(number / b - F.round(number / b)) < 1e-9)):
        if k in s:
            when("number", test(F.lit(float(s[k]))))
    if "minLength" in s:
        when("string", F.length(text) >= s["minLength"])
    if "maxLength" in s:
        when("string", F.length(text) <= s["maxLength"])
    if "pattern" in s:
        when("string", text.rlike(s["pattern"]))
    if s.get("format") in FORMATS:
        when("string", text.rlike(rf"^(?:{FORMATS[s['format']]})\z"))

    if {"items", "contains", "uniqueItems", "minItems", "maxItems"} & set(s):
        elements = F.try_variant_get(v, path, "array<variant>")
        n = F.size(elements)
        if "minItems" in s:
            when("array", n >= s["minItems"])
        if "maxItems" in s:
            when("array", n <= s["maxItems"])
        if s.get("uniqueItems"):
            when("array", F.size(F.array_distinct(F.transform(elements, lambda x: F.to_json(x)))) == n)
        if "contains" in s:
            when("array", F.exists(elements, lambda x: fits(x, s["contains"])))
        if isinstance(s.get("items"), list):
            for i, sub in enumerate(s["items"]):
                when("array", (n <= i) | fits(F.get(elements, F.lit(i)), sub))
            if "additionalItems" in s:
                k = len(s["items"])
                when("array", (n <= k) | F.forall(F.slice(elements, k + 1, F.greatest(n - k, F.lit(0))), lambda x: fits(x, s["additionalItems"])))
        elif "items" in s:
            when("array", F.forall(elements, lambda x: fits(x, s["items"])))

    if {"properties", "required", "minProperties", "maxProperties", "additionalProperties", "patternProperties", "propertyNames", "dependencies"} & set(s):
        members = F.try_variant_get(v, path, "map<string,variant>")
        names = F.map_keys(members)
        own, patterns = s.get("properties", {}), s.get("patternProperties", {})
        if "minProperties" in s:
            when("object", F.size(names) >= s["minProperties"])
        if "maxProperties" in s:
            when("object", F.size(names) <= s["maxProperties"])
        for name in s.get("required", []):
            when("object", F.array_contains(names, name))
        for name, sub in own.items():
            when("object", ~F.array_contains(names, name) | fits(F.try_element_at(members, F.lit(name)), sub))
        for p, sub in patterns.items():
            when("object", F.forall(F.map_entries(members), lambda e: ~e["key"].rlike(p) | fits(e["value"], sub)))
        if "additionalProperties" in s:
            listed = lambda k: some([k.isin(*own)] if own else []) | some([k.rlike(p) for p in patterns])
            when("object", F.forall(F.map_entries(members), lambda e: listed(e["key"]) | fits(e["value"], s["additionalProperties"])))
        if "propertyNames" in s:
            when("object", F.forall(names, lambda k: fits(_as_json(k), s["propertyNames"])))
        for name, need in s.get("dependencies", {}).items():
            met = F.size(F.array_except(F.array(*map(F.lit, need)).cast("array<string>"), names)) == 0 if isinstance(need, list) else fits(v, need, path)
            when("object", ~F.array_contains(names, name) | met)

    if "not" in s:
        tests.append(~fits(v, s["not"], path))
    tests += [fits(v, sub, path) for sub in s.get("allOf", [])]
    if "anyOf" in s:
        tests.append(some([fits(v, sub, path) for sub in s["anyOf"]]))
    if "oneOf" in s:
        tests.append(sum((fits(v, sub, path).cast("int") for sub in s["oneOf"]), F.lit(0)) == 1)
    if "if" in s:
        tests.append(F.when(fits(v, s["if"], path), fits(v, s.get("then", True), path)).otherwise(fits(v, s.get("else", True), path)))
    ok = F.lit(True)
    for x in tests:
        ok = ok & x
    return F.coalesce(ok, F.lit(False))


def _same(a, b) -> bool:
    """Equality of JSON values: true and 1 differ, 1 and 1.0 do not."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return set(a) == set(b) and all(_same(a[k], b[k]) for k in a)
    return a == b and isinstance(a, str) == isinstance(b, str)


def check(x, s: dict | bool, root=None) -> bool:
    """Whether one Python value from JSON fits a schema."""
    root = s if root is None else root
    if isinstance(s, bool):
        return s
    if "$ref" in s:
        return check(x, _target(root, s["$ref"]), root)
    go = lambda y, sub: check(y, sub, root)
    real = isinstance(x, (int, float)) and not isinstance(x, bool)
    kinds = {"null": x is None, "boolean": isinstance(x, bool), "number": real, "integer": real and x == int(x), "string": isinstance(x, str), "array": isinstance(x, list), "object": isinstance(x, dict)}
    listed = s.get("type", [])
    ok = not listed or any(kinds[k] for k in ([listed] if isinstance(listed, str) else listed))
    ok = ok and ("const" not in s or _same(x, s["const"])) and ("enum" not in s or any(_same(x, y) for y in s["enum"]))
    if ok and real:
        ok = x >= s.get("minimum", x) and x <= s.get("maximum", x) and ("exclusiveMinimum" not in s or x > s["exclusiveMinimum"]) and ("exclusiveMaximum" not in s or x < s["exclusiveMaximum"])
        ok = ok and ("multipleOf" not in s or abs(x / s["multipleOf"] - round(x / s["multipleOf"])) < 1e-9)
    if ok and isinstance(x, str):
        ok = s.get("minLength", 0) <= len(x) <= s.get("maxLength", len(x)) and ("pattern" not in s or re.search(s["pattern"], x) is not None)
        ok = ok and (s.get("format") not in FORMATS or re.fullmatch(FORMATS[s["format"]], x) is not None)
    if ok and isinstance(x, list):
        ok = s.get("minItems", 0) <= len(x) <= s.get("maxItems", len(x)) and ("contains" not in s or any(go(y, s["contains"]) for y in x))
        ok = ok and not (s.get("uniqueItems") and any(_same(y, z) for i, y in enumerate(x) for z in x[:i]))
        each = s.get("items", True)
        if isinstance(each, list):
            ok = ok and all(map(go, x, each)) and all(go(y, s.get("additionalItems", True)) for y in x[len(each) :])
        else:
            ok = ok and all(go(y, each) for y in x)
    if ok and isinstance(x, dict):
        own, patterns = s.get("properties", {}), s.get("patternProperties", {})
        ok = s.get("minProperties", 0) <= len(x) <= s.get("maxProperties", len(x)) and set(s.get("required", [])) <= set(x)
        ok = ok and all(go(x[k], sub) for k, sub in own.items() if k in x) and all(go(y, sub) for p, sub in patterns.items() for k, y in x.items() if re.search(p, k))
        ok = ok and all(go(y, s.get("additionalProperties", True)) for k, y in x.items() if k not in own and not any(re.search(p, k) for p in patterns))
        ok = ok and all(go(k, s.get("propertyNames", True)) for k in x)
        ok = ok and all(set(need) <= set(x) if isinstance(need, list) else go(x, need) for k, need in s.get("dependencies", {}).items() if k in x)
    ok = ok and not ("not" in s and go(x, s["not"])) and all(go(x, sub) for sub in s.get("allOf", []))
    ok = ok and ("anyOf" not in s or any(go(x, sub) for sub in s["anyOf"])) and ("oneOf" not in s or sum(go(x, sub) for sub in s["oneOf"]) == 1)
    if ok and "if" in s:
        ok = go(x, s.get("then", True) if go(x, s["if"]) else s.get("else", True))
    return ok


def _checker(schema: str):
    @F.pandas_udf(T.BooleanType())
    def run(c: pd.Series) -> pd.Series:
        s = json.loads(schema)

        def one(text: str | None) -> bool:
            try:
                return text is not None and check(json.loads(text), s)
            except (ValueError, RecursionError):
                return False

        return c.map(one).astype(bool)

    return run


def column_path(c: Column, path: str) -> Column:
    """A path like a.b[3] or a.'odd name'[0] into structs, arrays and maps; what is missing is null."""
    for name, quoted, index in re.findall(r"([A-Za-z_][\w ]*)|'([^']*)'|\[(-?\d+)\]", path):
        c = F.get(c, int(index)) if index else c.getField(name or quoted)
    return c


def json_path(path: str) -> str:
    """The same path language as a JSON path."""
    return "$" + "".join(f"[{i}]" if i else f"['{n or q}']" for n, q, i in re.findall(r"([A-Za-z_][\w ]*)|'([^']*)'|\[(\d+)\]", path))


def nth_duplicate(pairs: Column, name: str, n: int = 0) -> Column:
    """Value of the n-th pair of a name in an array of (key, value)."""
    return F.get(F.filter(pairs, lambda p: p["key"] == name), n)["value"]


_WALK = T.StructType([*[T.StructField(n, T.StringType()) for n in ("path", "name", "type", "value")], T.StructField("depth", T.IntegerType())])


@F.udtf(returnType=_WALK)
class ExplodePaths:
    """Every value inside a JSON text, depth first: its path, name, type, scalar value and depth."""

    def eval(self, text: str, limit: int | None):
        import json as j

        if text is None:
            return
        try:
            root = j.loads(text)
        except ValueError:
            return
        stack = [("$", "", root, 0)]
        while stack:
            path, name, x, depth = stack.pop()
            kind = "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "boolean" if isinstance(x, bool) else "null" if x is None else "string" if isinstance(x, str) else "number"
            yield path, name, kind, None if kind in ("object", "array", "null") else x if kind == "string" else j.dumps(x), depth
            if limit is None or depth < limit:
                kids = [(f"{path}['{k}']", k, v, depth + 1) for k, v in x.items()] if kind == "object" else [(f"{path}[{i}]", str(i), v, depth + 1) for i, v in enumerate(x)] if kind == "array" else []
                stack += reversed(kids)


def explode_paths(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """df with a row for each value inside the JSON of a column, up to a depth if one is given."""
    return df.lateralJoin(ExplodePaths(F.col(column).outer(), F.lit(limit).cast("int")))


def find_by_name(df: DataFrame, column: str, glob: str, limit: int | None = None) -> DataFrame:
    from .strings import glob_match

    return explode_paths(df, column, limit).where(glob_match(F.col("name"), glob))


def find_by_value(df: DataFrame, column: str, glob: str, limit: int | None = None) -> DataFrame:
    from .strings import glob_match

    return explode_paths(df, column, limit).where(F.coalesce(glob_match(F.col("value"), glob), F.lit(False)))


def find_by_type(df: DataFrame, column: str, type_name: str, limit: int | None = None) -> DataFrame:
    return explode_paths(df, column, limit).where(F.col("type") == type_name)


def quoted(text: str) -> str:
    return quote(text)
