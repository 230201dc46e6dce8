"""Canonical forms as column expressions: compiled from a schema, or unrolled over VARIANT to a given depth.

The text is that of ``canonical.canonical`` as JSON, byte by byte, without a
Python worker: numbers to eight exact decimals, strings in normal form C,
characters outside printable ASCII escaped, keys in order.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.canonical import VERSION

#: Containers within containers that a text may have; deeper ones are not read.
DEPTH = 16
_E8, _E9, _LOW = 100_000_000, 1_000_000_000, (1 << 32) - 1
_TWO32, _TWO63 = float(1 << 32), float(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


# Numbers.


def float8(value: Column) -> Column:
    """A double to eight decimals of its exact binary value, ties to even; nan and infinities by name; null for null."""
    sign = lambda x: F.when(x < 0, "-").otherwise("")
    size = lambda a: F.when(a == float("inf"), "inf").when(a < _TWO63, _fixed(a)).otherwise(_large(a))
    return F.when(value.isNotNull(), let(value.cast("double"), lambda x: F.when(F.isnan(x), "nan").otherwise(F.concat(sign(x), size(F.abs(x))))))


def _fixed(a: Column) -> Column:
    """Of a double under 2 ** 63: its fraction in three pieces of 32 bits, times 10 ** 8, is a whole number and a rest that is compared with a half."""
    whole = F.when(a < _TWO63, a).otherwise(0.0).cast("long")
    down = lambda x: F.floor(x).cast("long")
    parts = let(F.struct(whole.alias("w"), (a - whole).alias("f")), lambda s: let(F.struct(s["w"].alias("w"), down(s["f"] * _TWO32).alias("h"), (s["f"] * _TWO32).alias("x")), lambda s: _third(s, down)))
    return let(parts, _rounded)


def _third(s: Column, down: Callable[[Column], Column]) -> Column:
    rest = (s["x"] - s["h"]) * _TWO32
    return let(F.struct(s["w"].alias("w"), s["h"].alias("h"), rest.alias("x")), lambda s: F.struct(s["w"].alias("w"), s["h"].alias("h"), down(s["x"]).alias("m"), down((s["x"] - down(s["x"])) * _TWO32).alias("l")))


def _rounded(p: Column) -> Column:
    low = p["l"] * _E8
    return let(F.struct(p["w"].alias("w"), p["h"].alias("h"), low.alias("low"), (p["m"] * _E8 + F.shiftright(low, 32)).alias("mid")), lambda s: let(F.struct(s["w"].alias("w"), (s["h"] * _E8 + F.shiftright(s["mid"], 32)).alias("high"), ((s["low"].bitwiseAND(_LOW) > 0) | (s["mid"].bitwiseAND(_LOW) > 0)).alias("more")), _decimals))


def _decimals(s: Column) -> Column:
    count, rest, half = F.shiftright(s["high"], 32), s["high"].bitwiseAND(_LOW), 1 << 31
    up = (rest > half) | ((rest == half) & (s["more"] | (count % 2 == 1)))
    return let(count + up.cast("long"), lambda n: F.concat((s["w"] + F.when(n == _E8, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((n % _E8).cast("string"), 8, "0")))


def _div(n: Column, by: int) -> Column:
    return F.call_function("div", n, F.lit(by))


def _times(limbs: Column, factor: Column) -> Column:
    """A whole number in limbs of nine digits, least first, times a factor under 2 ** 29."""
    empty = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: let(x * factor + acc["carry"], lambda t: F.struct(_div(t, _E9).alias("carry"), F.array_append(acc["out"], t % _E9).alias("out")))
    return F.aggregate(limbs, empty, step, lambda acc: F.when(acc["carry"] > 0, F.array_append(acc["out"], acc["carry"])).otherwise(acc["out"]))


def _large(a: Column) -> Column:
    """Of a double from 2 ** 63 on: a whole number, its 53 bits times a power of two in limbs."""
    a = F.when((a >= _TWO63) & (a < float("inf")), a).otherwise(_TWO63)
    power = (F.floor(F.log2(a)) - 53).cast("int")
    bits = (a * F.pow(F.lit(2.0), -power.cast("double"))).cast("long")
    start = lambda s: F.array(s["bits"] % _E9, _div(s["bits"], _E9))
    times = lambda s: F.aggregate(F.filter(F.sequence(F.lit(0), (s["power"] / 28).cast("int")), lambda k: k > 0), start(s), lambda acc, _: _times(acc, F.lit(1 << 28).cast("long")))
    whole = lambda s: _times(times(s), F.pow(F.lit(2.0), (s["power"] % 28).cast("double")).cast("long"))
    digits = let(F.struct(power.alias("power"), bits.alias("bits")), whole)
    return F.concat(F.regexp_replace(F.array_join(F.transform(F.reverse(digits), lambda x: F.lpad(x.cast("string"), 9, "0")), ""), "^0+(?=[0-9])", ""), F.lit(".00000000"))


# Strings.


def _ranges(points: Iterable[int]) -> str:
    """A class of characters for a regular expression."""
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in out)


@lru_cache
def _unicode() -> tuple[str, str, dict[str, str], dict[str, str], dict[str, str]]:
    """By rule from Python's character data: the class of characters that normal form C may change or join, that of marks, and tables of full decompositions, of marks' classes and of pairs that compose."""
    full, marks, pairs, joined = {}, {}, {}, set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for p in range(0x300 - 0x250, sys.maxunicode + 1):
        c = chr(p)
        if 0xAC00 <= p < 0xD7A4 or 0xD800 <= p < 0xE000:
            continue
        if k := unicodedata.combining(c):
            marks[c] = str(k)
        parts = unicodedata.decomposition(c)
        if not parts or parts.startswith("<"):
            continue
        full[c] = unicodedata.normalize("NFD", c)
        own = [chr(int(x, 16)) for x in parts.split()]
        if len(own) == 2 and unicodedata.normalize("NFC", "".join(own)) == c:
            pairs["".join(own)] = c
            joined.add(ord(own[1]))
    changed = {ord(c) for c in full if unicodedata.normalize("NFC", c) != c}
    return _ranges(sorted(joined | changed | {ord(c) for c in marks})), _ranges(sorted(map(ord, marks))), full, marks, pairs


@lru_cache
def _plain(least: int = 200) -> str:
    """The long stretches of characters that normal form C leaves as they are: a short class, as each character of a text is tried against it."""
    risky = re.compile(f"[{re.sub(r'x.([0-9a-f]+).', lambda m: f'U{int(m[1], 16):08x}', _unicode()[0])}]")
    out, start = [], 0
    for p in [m.start() for m in risky.finditer("".join(chr(p) if not 0xD800 <= p < 0xE000 else " " for p in range(sys.maxunicode + 1)))] + [sys.maxunicode + 1]:
        out += [range(start, p)] if p - start >= least else []
        start = p + 1
    return _ranges(p for r in out for p in r)


def _table(pairs: dict[str, str]) -> Column:
    """A map that the optimizer folds to one literal."""
    return F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in pairs.items())), F.lit("\u0001"), F.lit("\u0002"))


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"))


def nfc(text: Column) -> Column:
    """A text in normal form C. Only a character that may change or join, with what is before it, is looked up."""
    risky, mark, full, marks, pairs = _unicode()
    rank = lambda c: F.coalesce(F.try_element_at(_table(marks), c).cast("int"), F.lit(0))
    point = lambda c: F.ascii(c)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 4, "0")), "UTF-16BE")

    def together(pair: Column, a: Column, b: Column) -> Column:
        """What two characters compose to, or null; syllables by their numbers."""
        syllable = F.when(point(a).between(0x1100, 0x1112) & point(b).between(0x1161, 0x1175), char(0xAC00 + ((point(a) - 0x1100) * 21 + point(b) - 0x1161) * 28))
        closed = F.when(point(a).between(0xAC00, 0xD7A3) & ((point(a) - 0xAC00) % 28 == 0) & point(b).between(0x11A8, 0x11C2), char(point(a) + point(b) - 0x11A7))
        return F.coalesce(F.try_element_at(_table(pairs), pair), syllable, closed)

    def step(acc: Column, x: Column) -> Column:
        open_ = (acc["first"] != "") & ((acc["tail"] == "") | (acc["rank"] < x["rank"]))
        state = lambda done, first, tail, r: F.struct(done.alias("done"), first.alias("first"), tail.alias("tail"), r.alias("rank"))
        return let(F.when(open_, together(F.concat(acc["first"], x["char"]), acc["first"], x["char"])), lambda made: F.when(made.isNotNull(), state(acc["done"], made, acc["tail"], acc["rank"])).when(x["rank"] == 0, state(F.concat(acc["done"], acc["first"], acc["tail"]), x["char"], F.lit(""), F.lit(0))).otherwise(state(acc["done"], acc["first"], F.concat(acc["tail"], x["char"]), x["rank"])))

    def small(part: Column) -> Column:
        apart = F.array_join(F.transform(_chars(part), lambda c: F.coalesce(F.try_element_at(_table(full), c), c)), "")
        # Each starter with its marks, these in order of their classes.
        groups = F.regexp_extract_all(apart, F.lit(f"(?s)([^{mark}][{mark}]*|[{mark}]+)"))
        sorted_ = F.flatten(F.transform(groups, lambda g: F.array_sort(F.transform(_chars(g), lambda c, i: F.struct(rank(c).alias("rank"), i.alias("at"), c.alias("char"))))))
        empty = F.struct(F.lit("").alias("done"), F.lit("").alias("first"), F.lit("").alias("tail"), F.lit(0).alias("rank"))
        return F.aggregate(sorted_, empty, step, lambda acc: F.concat(acc["done"], acc["first"], acc["tail"]))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s)([^{risky}]?[{risky}]+|[^{risky}]+(?![{risky}]))"))
    whole = F.array_join(F.transform(pieces, lambda p: F.when(F.rlike(p, F.lit(f"[{risky}]")), small(p)).otherwise(p)), "")
    # Most texts need the first look only, or the second: a class of hundreds of ranges takes as many steps for a character.
    looks = ["[^\\x{0}-\\x{2ff}]", f"[^{_plain()}]", f"[{risky}]"]
    return F.when(reduce(and_, (F.rlike(text, F.lit(look)) for look in looks)), whole).otherwise(text)


def quoted(text: Column, prefix: str = "") -> Column:
    """A JSON string of a text after a plain prefix; all but printable ASCII is escaped, by UTF-16 units."""
    plain = lambda t: F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def units(part: Column) -> Column:
        out = F.regexp_replace(F.lower(F.hex(F.encode(part, "UTF-16BE"))), "(....)", r"\\u$1")
        for code, short in (("000a", "n"), ("000d", "r"), ("0009", "t"), ("0008", "b"), ("000c", "f")):
            out = F.replace(out, F.lit(f"\\u{code}"), F.lit(f"\\{short}"))
        return out

    parts = F.regexp_extract_all(text, F.lit("([\\x20-\\x7e]+|[^\\x20-\\x7e]+)"))
    mixed = F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("^[\\x20-\\x7e]")), plain(p)).otherwise(units(p))), "")
    return F.concat(F.lit('"' + prefix), F.when(F.rlike(text, F.lit("[^\\x20-\\x7e]")), mixed).otherwise(plain(text)), F.lit('"'))


def _string(text: Column, version: str) -> Column:
    if version == "1":
        return quoted(text)
    # ASCII needs no look at its line ends or form.
    formed = F.when(F.rlike(text, F.lit("[^\\x20-\\x7e]")), let(F.regexp_replace(text, "\r\n?", "\n"), nfc)).otherwise(text)
    # What is looked at several times is made once.
    return let(formed, lambda t: quoted(t, "s:"))


# Nested values.


def canonical_json(value: Column, kind: T.DataType, version: str = VERSION) -> Column:
    """The canonical JSON of a column of this type: structs and maps of text as objects, arrays, text, whole and binary numbers, booleans. Null is the null tag wherever it is; a struct has all its fields."""
    if isinstance(kind, T.StructType):
        names = sorted(f.name for f in kind)
        if len(set(names)) < len(names):
            raise TypeError("a struct names a field twice")
        parts = []
        for k, name in enumerate(names):
            # In the JSON of a literal a "$" or quote needs no care: it is no pattern.
            parts += [F.lit(("{" if not k else ", ") + json.dumps(name) + ": "), canonical_json(value[name], kind[name].dataType, version)]
        out = F.concat(*parts, F.lit("}")) if parts else F.lit("{}")
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.transform(F.map_keys(value), lambda k: F.struct(k.alias("key"), value[k].alias("value"))), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), canonical_json(e["value"], kind.valueType, version))), ", "), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType, version)), ", "), F.lit("]"))
    elif isinstance(kind, T.StringType):
        out = _string(value, version)
    elif isinstance(kind, T.BooleanType):
        out = F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    elif isinstance(kind, T.IntegralType):
        out = F.concat(F.lit('"'), value.cast("string"), F.lit(':int"'))
    elif isinstance(kind, T.FloatType | T.DoubleType):
        out = F.concat(F.lit('"'), float8(value), F.lit('"'))
    elif isinstance(kind, T.NullType):
        return F.lit('"null"')
    else:
        raise TypeError(f"no canonical form for {kind.simpleString()}")
    return F.when(value.isNull(), '"null"').otherwise(out)


def nesting(text: Column) -> Column:
    """How many containers of a JSON text hold each other, at most."""
    brackets = F.regexp_extract_all(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), F.lit("([\\[\\]{}])"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda acc, b: let(acc["now"] + F.when(b.isin("[", "{"), 1).otherwise(-1), lambda n: F.struct(n.alias("now"), F.greatest(acc["most"], n).alias("most")))
    return F.aggregate(brackets, start, step, lambda acc: acc["most"])


def _token(kind: str | Column, text: str | Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(kind).alias("kind"), as_column(text).alias("text"))


def tokens(value: Column, depth: int) -> Column:
    """The pieces of a VARIANT's canonical JSON in order: (kind, text), kind MARK for what stands as it is, KEY, the type of a scalar, or DEEP for a container below ``depth`` others.

    Objects and arrays are one list of (key, value) each, so that the
    expression grows with the depth and not as its power.
    """
    return let(F.struct(value.alias("v"), F.schema_of_variant(value).alias("k")), lambda s: _tokens(s["v"], s["k"], depth))


def _tokens(v: Column, kind: Column, depth: int) -> Column:
    is_object, is_array = F.startswith(kind, F.lit("OBJECT")), F.startswith(kind, F.lit("ARRAY"))
    if not depth:
        return F.array(_token(F.when(is_object | is_array, "DEEP").otherwise(kind), v.cast("string")))
    items = F.transform(v.cast("array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.when(is_object | is_array, _joined(F.when(is_object, entries(v)).otherwise(items), is_object, lambda e: tokens(e["value"], depth - 1))).otherwise(F.array(_token(kind, v.cast("string"))))


def _joined(pairs: Column, is_object: Column, inner: Callable[[Column], Column]) -> Column:
    before = lambda e, i: F.array(_token("MARK", F.when(i > 0, ", ").otherwise("")), _token("KEY", e["key"]), _token("MARK", F.when(e["key"].isNotNull(), ": ").otherwise("")))
    own = F.flatten(F.transform(pairs, lambda e, i: F.concat(before(e, i), inner(e))))
    return F.concat(F.array(_token("MARK", F.when(is_object, "{").otherwise("["))), own, F.array(_token("MARK", F.when(is_object, "}").otherwise("]"))))


def rendered(pieces: Column, version: str = VERSION) -> Column:
    """The text of tokens; null if any is too deep. A decimal is a binary number, unless it is one that no long can hold: those are whole."""

    def one(x: Column) -> Column:
        kind, text = x["kind"], x["text"]
        # Nineteen digits and more are a whole number from 2 ** 63 on; a longer fraction has another type.
        whole = F.rlike(kind, F.lit("^DECIMAL\\([0-9]+,0\\)$")) & (F.abs(F.when(F.rlike(kind, F.lit("^DECIMAL\\([0-9]+,0\\)$")), text).cast("decimal(38,0)")) >= F.lit(str(1 << 63)).cast("decimal(38,0)"))
        number = F.when(~F.coalesce(whole, F.lit(False)), float8(F.when((kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), text).cast("double")))
        tagged = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
        return F.when(kind == "MARK", text).when(kind == "KEY", F.coalesce(quoted(text), F.lit(""))).when(kind == "STRING", _string(text, version)).when(kind == "VOID", '"null"').when(kind == "BOOLEAN", tagged(text)).when((kind == "BIGINT") | F.coalesce(whole, F.lit(False)), tagged(F.concat(text, F.lit(":int")))).otherwise(tagged(number))

    return let(pieces, lambda own: F.when(~F.exists(own, lambda x: x["kind"] == "DEEP"), F.array_join(F.transform(own, one), "")))


def variant_json(value: Column, depth: int, version: str = VERSION) -> Column:
    """The canonical JSON of a VARIANT whose containers hold at most ``depth`` each other; null for what is deeper."""
    return rendered(tokens(value, depth), version)


def entries(variant: Column) -> Column:
    """(key, value) of an object's fields in order of keys."""
    pairs = F.transform(F.map_entries(variant.cast("map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return F.array_sort(pairs, lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))


def canonical_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
