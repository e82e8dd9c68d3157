"""SAM text, and BAM in BGZF blocks, as DataFrames; SAM back to text."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandspark.functions.text import cigar_operations, cigar_text
from strandspark.sources import ranges

TAG = "struct<type:string,i:bigint,f:double,z:string,h:binary,bi:array<bigint>,bf:array<double>,ord:int>"
SCHEMA = f"qname string, flag int, rname string, pos0 int, mapq int, cigar array<struct<op:string,len:int>>, rnext string, pnext0 int, tlen int, seq string, qual string, tags map<string,{TAG}>"
OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"


def read_header(spark: SparkSession, path: str) -> list[tuple[str, dict[str, str]]]:
    """(record type, fields) of the @ lines, read from the start of the file."""
    n = 256
    while True:
        lines = [r["value"] for r in spark.read.text(path).limit(n).collect()]
        head = [x for x in lines if x.startswith("@")]
        if len(head) < len(lines) or len(lines) < n:
            return header_records(head)
        n *= 8


def header_records(lines: list[str]) -> list[tuple[str, dict[str, str]]]:
    out = []
    for line in lines:
        kind, _, rest = line[1:].partition("\t")
        out.append((kind, {"text": rest} if kind == "CO" else dict(f.split(":", 1) for f in rest.split("\t") if ":" in f)))
    return out


#: Sort orders and groupings that a header may name.
SORT_ORDERS = ["unknown", "unsorted", "queryname", "coordinate"]
GROUPINGS = ["none", "query", "reference"]


def header_text(header: list[tuple[str, dict[str, str]]]) -> list[str]:
    """Header records as lines: HD first, then SQ, RG, PG and comments, each kind in its order."""
    order = ["HD", "SQ", "RG", "PG", "CO"]
    lines = []
    for kind, fields in sorted(header, key=lambda x: order.index(x[0]) if x[0] in order else len(order)):
        lines.append(f"@{kind}\t{fields['text']}" if kind == "CO" else "\t".join([f"@{kind}", *(f"{k}:{v}" for k, v in fields.items())]))
    return lines


def sort_order(header: list[tuple[str, dict[str, str]]]) -> tuple[str, str]:
    """Sort order and grouping; names that are not known are an error."""
    hd = next((f for k, f in header if k == "HD"), {})
    order, grouping = hd.get("SO", "unknown"), hd.get("GO", "none")
    if order not in SORT_ORDERS or grouping not in GROUPINGS:
        raise ValueError(f"unknown sort order or grouping: {order}, {grouping}")
    return order, grouping


def header_subset(header: list[tuple[str, dict[str, str]]], kinds: list[str], references: list[str] | None = None) -> list[tuple[str, dict[str, str]]]:
    """Copy of the records of some kinds, and of the named reference sequences only."""
    return [(k, dict(f)) for k, f in header if k in kinds and (k != "SQ" or references is None or f["SN"] in references)]


def header_rename(header: list[tuple[str, dict[str, str]]], kind: str, names: dict[str, str]) -> list[tuple[str, dict[str, str]]]:
    """Copy with other names (SN of SQ, else ID); a name twice in a kind is an error. Programs keep pointing to theirs."""
    key = "SN" if kind == "SQ" else "ID"
    out = []
    for k, f in header:
        f = dict(f)
        if k == kind and key in f:
            f[key] = names.get(f[key], f[key])
        if k == kind == "PG" and "PP" in f:
            f["PP"] = names.get(f["PP"], f["PP"])
        out.append((k, f))
    used = [f[key] for k, f in out if k == kind and key in f]
    if len(set(used)) < len(used):
        raise ValueError(f"names of {kind} records repeat")
    return out


def with_reference(df: DataFrame, references: DataFrame, name: str = "rname") -> DataFrame:
    """Add the number and length (null if the name is not there) of each record's reference; Spark chooses the join by size."""
    refs = references.select(F.col("name").alias("_name"), F.col("rname_id"), F.col("length").alias("rname_length"))
    return df.join(refs, F.col(name) == F.col("_name"), "left").drop("_name")


def write_sam(df: DataFrame, header: list[tuple[str, dict[str, str]]], path: str, order: list[str] | None = None) -> None:
    """A folder of text parts whose first holds the header, so that the parts in order are one file."""
    body = record_text(df.orderBy(*order) if order else df)
    head = df.sparkSession.createDataFrame([(x,) for x in header_text(header)], "value string").coalesce(1)
    head.union(body).write.text(path)


def references(spark: SparkSession, header) -> DataFrame:
    rows = [(i, f["SN"], int(f["LN"])) for i, f in enumerate(f for k, f in header if k == "SQ")]
    return spark.createDataFrame(rows, "rname_id int, name string, length bigint")


def _tag(field: Column, ord_: Column) -> Column:
    kind, v = F.substr(field, F.lit(4), F.lit(1)), F.substr(field, F.lit(6))
    sub = F.substr(v, F.lit(1), F.lit(1))
    items = F.split(F.substr(v, F.lit(3)), ",")
    array = kind == "B"
    return F.struct(
        F.when(array, F.concat(kind, sub)).otherwise(kind).alias("type"),
        F.when(kind == "i", v.try_cast("bigint")).alias("i"), F.when(kind == "f", v.try_cast("double")).alias("f"), F.when(kind.isin("A", "Z"), v).alias("z"),
        F.when((kind == "H") & v.rlike("^([0-9A-F]{2})*$"), F.unhex(v)).alias("h"),
        F.when(array & (sub != "f"), F.transform(items, lambda x: x.try_cast("bigint"))).alias("bi"), F.when(array & (sub == "f"), F.transform(items, lambda x: x.try_cast("double"))).alias("bf"), ord_.cast("int").alias("ord"),
    )


def read_sam(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """Records with 0-based positions; ``*`` is null, ``=`` in RNEXT is RNAME. ``mode``: FAILFAST raises at a malformed record,
    PERMISSIVE keeps it with what can be read and ``_error``, DROPMALFORMED leaves it out."""
    return records(spark.read.text(path), mode)


def records(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Lines (column value) as records; works on streams too. Of a repeated tag the first counts, and the record is malformed."""
    c = lambda i: F.get("c", F.lit(i))
    rows = lines.where("value <> '' AND NOT startswith(value, '@')").select(F.split("value", "\t").alias("c"))
    star = lambda i: F.when(c(i) != "*", c(i))
    texts = F.slice("c", F.lit(12), F.greatest(F.size("c") - 11, F.lit(0)))
    rows = rows.withColumn("_t", texts).withColumn("_k", F.transform("_t", lambda t: F.substr(t, F.lit(1), F.lit(2))))
    first = F.filter(F.arrays_zip(F.col("_k").alias("k"), F.col("_t").alias("t")), lambda p, i: F.array_position("_k", p["k"]) == i + 1)
    tags = F.transform(first, lambda p, i: F.struct(p["k"].alias("key"), _tag(p["t"], i).alias("value")))
    within = lambda i, low, high: ~F.coalesce(c(i).try_cast("bigint").between(low, high), F.lit(False))
    malformed = lambda t: ~t.rlike(r"^[A-Za-z][A-Za-z0-9]:([AZ]:[ -~]*|i:[-+]?\d+|f:[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|H:([0-9A-F]{2})*|B:[cCsSiIf](,[-+0-9.eE]+)*)$")
    top = (1 << 31) - 1
    error = F.concat_ws(
        "; ",
        F.when(F.size("c") < 11, "too few columns"),
        F.when(within(1, 0, 65535), "FLAG is not a number of 16 bits"),
        F.when(within(3, 0, top), "POS is not a position"),
        F.when(within(4, 0, 255), "MAPQ is not a number of 8 bits"),
        F.when(cigar_operations(c(5)).isNull(), "CIGAR is malformed"),
        F.when(within(7, 0, top), "PNEXT is not a position"),
        F.when(within(8, -top, top), "TLEN is not a number"),
        F.when(F.exists("_t", malformed), "a tag is malformed"),
        F.when(F.size(F.array_distinct("_k")) < F.size("_k"), "a tag repeats"),
    )
    out = rows.select(
        star(0).alias("qname"), c(1).try_cast("int").alias("flag"), star(2).alias("rname"), (c(3).try_cast("int") - 1).alias("pos0"), c(4).try_cast("int").alias("mapq"), cigar_operations(c(5)).alias("cigar"),
        F.when(c(6) == "=", star(2)).otherwise(star(6)).alias("rnext"), (c(7).try_cast("int") - 1).alias("pnext0"), c(8).try_cast("int").alias("tlen"), star(9).alias("seq"), star(10).alias("qual"),
        F.map_from_entries(tags).alias("tags"), F.nullif(error, F.lit("")).alias("_error"),
    )
    if mode == "DROPMALFORMED":
        return out.where("_error IS NULL").drop("_error")
    if mode == "FAILFAST":
        return out.withColumn("qname", F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error")).cast("string")).otherwise(F.col("qname"))).drop("_error")
    return out


def _tag_text(k: Column, t: Column) -> Column:
    listed = F.coalesce(F.array_join(F.transform(t["bi"], lambda x: x.cast("string")), ","), F.array_join(F.transform(t["bf"], lambda x: x.cast("string")), ","))
    value = F.coalesce(t["i"].cast("string"), t["f"].cast("string"), t["z"], F.hex(t["h"]), F.concat(F.substr(t["type"], F.lit(2), F.lit(1)), F.lit(","), listed))
    return F.concat_ws(":", k, F.substr(t["type"], F.lit(1), F.lit(1)), value)


def record_text(df: DataFrame, sort_tags: bool = False) -> DataFrame:
    """Records as lines; tags in the order they were read, or by name."""
    entries = F.map_entries("tags")
    rank = (lambda e: e["key"]) if sort_tags else (lambda e: e["value"]["ord"])
    sorted_ = F.array_sort(F.transform(entries, lambda e: F.struct(rank(e).alias("r"), e["key"].alias("k"), e["value"].alias("v"))), lambda a, b: F.when(a["r"] < b["r"], -1).when(a["r"] > b["r"], 1).otherwise(0))
    star = lambda x: F.coalesce(F.col(x), F.lit("*"))
    rnext = F.when(F.col("rnext").isNull(), "*").when(F.col("rnext") == F.col("rname"), "=").otherwise(F.col("rnext"))
    fields = [star("qname"), F.col("flag"), star("rname"), F.col("pos0") + 1, F.col("mapq"), F.coalesce(cigar_text(F.col("cigar")), F.lit("*")), rnext, F.col("pnext0") + 1, F.col("tlen"), star("seq"), star("qual")]
    tags = F.transform(sorted_, lambda e: _tag_text(e["k"], e["v"]))
    return df.select(F.array_join(F.concat(F.array(*[f.cast("string") for f in fields]), tags), "\t").alias("value"))


def is_primary() -> Column:
    """Neither secondary nor supplementary."""
    return F.col("flag").bitwiseAND(0x900) == 0


def mapq_from_quality(quality: Column) -> Column:
    """A mapping quality that is written as a printable character's code, as a number from 0."""
    return quality - 33


def same_record(a: str, b: str, tolerance: float = 1e-9) -> Column:
    """Equality of two record structs, whatever the width of tag integers; floats within a relative tolerance."""
    x, y = F.col(a), F.col(b)
    plain = [x[f].eqNullSafe(y[f]) for f in ("qname", "flag", "rname", "pos0", "mapq", "rnext", "pnext0", "tlen", "seq", "qual", "cigar")]
    near = lambda p, q: p.eqNullSafe(q) | F.coalesce(F.abs(p - q) <= F.greatest(F.abs(p), F.abs(q)) * tolerance, F.lit(False))
    one = lambda k, t: F.coalesce(F.map_contains_key(y["tags"], k), F.lit(False)) & near(t["f"], y["tags"][k]["f"]) & t["i"].eqNullSafe(y["tags"][k]["i"]) & t["z"].eqNullSafe(y["tags"][k]["z"]) & t["h"].eqNullSafe(y["tags"][k]["h"]) & t["bi"].eqNullSafe(y["tags"][k]["bi"]) & t["bf"].eqNullSafe(y["tags"][k]["bf"])
    tags = F.forall(F.map_entries(x["tags"]), lambda e: one(e["key"], e["value"])) & (F.size(x["tags"]) == F.size(y["tags"]))
    out = tags
    for p in plain:
        out = out & p
    return out


def erase_tags(df: DataFrame, names: list[str]) -> DataFrame:
    """Without some tags; the others keep their order."""
    return df.withColumn("tags", F.map_filter("tags", lambda k, v: ~k.isin(*names)))


def erase_tags_if(df: DataFrame, predicate) -> DataFrame:
    """Without the tags for which ``predicate(name, tag)`` holds; null is no."""
    return df.withColumn("tags", F.map_filter("tags", lambda k, v: ~F.coalesce(predicate(k, v), F.lit(False))))


#: Field of the tag struct that holds the value of a type.
_FIELD = {"i": "i", "f": "f", "A": "z", "Z": "z", "H": "h"}


def obtain_tag(df: DataFrame, name: str, kind: str, value: Column) -> DataFrame:
    """Every record has the tag: one of the type is kept, one of another type is replaced where it stands, and a missing one is
    appended."""
    field = _FIELD.get(kind, "bf" if kind == "Bf" else "bi")
    schema = StructType.fromDDL(f"t {TAG}")["t"].dataType
    old = F.col("tags")[name]
    after = F.coalesce(F.array_max(F.transform(F.map_values("tags"), lambda t: t["ord"])) + 1, F.lit(0))
    parts = {"type": F.lit(kind), field: value, "ord": F.coalesce(old["ord"], after)}
    new = F.struct(*[parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    kept = F.coalesce(old["type"] == kind, F.lit(False))
    rest = F.map_filter("tags", lambda k, v: k != name)
    return df.withColumn("tags", F.when(kept, F.col("tags")).otherwise(F.map_concat(rest, F.create_map(F.lit(name), new))))


# --- BGZF and BAM --------------------------------------------------------------------------------------------------------


def bgzf_blocks(data: bytes) -> Iterator[bytes]:
    """Inflated blocks; sizes and checksums are verified."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        extra = struct.unpack_from("<H", data, at + 10)[0]
        p, size = at + 12, None
        while p < at + 12 + extra:
            tag, n = data[p : p + 2], struct.unpack_from("<H", data, p + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", data, p + 4)[0] + 1
            p += 4 + n
        if size is None:
            raise ValueError("a block without its size")
        raw = zlib.decompress(data[at + 12 + extra : at + size - 8], -15)
        crc, n = struct.unpack_from("<II", data, at + size - 8)
        if zlib.crc32(raw) != crc or len(raw) != n:
            raise ValueError("a block's checksum is wrong")
        yield raw
        at += size


def write_bgzf(data: bytes, block: int = 65280) -> bytes:
    out = []
    for at in [*range(0, len(data), block), None]:
        part = b"" if at is None else data[at : at + block]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


_INT = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}


def _bam_tags(b: bytes, at: int, end: int) -> dict:
    out = {}
    while at < end:
        key, kind = b[at : at + 2].decode(), chr(b[at + 2])
        at += 3
        t = {"type": kind, "i": None, "f": None, "z": None, "h": None, "bi": None, "bf": None, "ord": len(out)}
        if kind in _INT:
            t["type"], t["i"] = "i", struct.unpack_from("<" + _INT[kind], b, at)[0]
            at += struct.calcsize(_INT[kind])
        elif kind == "f":
            t["f"] = struct.unpack_from("<f", b, at)[0]
            at += 4
        elif kind == "A":
            t["z"] = chr(b[at])
            at += 1
        elif kind in "ZH":
            stop = b.index(0, at)
            if kind == "Z":
                t["z"] = b[at:stop].decode()
            else:
                t["h"] = bytes.fromhex(b[at:stop].decode())
            at = stop + 1
        elif kind == "B":
            sub, n = chr(b[at]), struct.unpack_from("<i", b, at + 1)[0]
            code = "f" if sub == "f" else _INT[sub]
            values = list(struct.unpack_from(f"<{n}{code}", b, at + 5))
            t["type"], t["bf" if sub == "f" else "bi"] = "B" + sub, values
            at += 5 + struct.calcsize(code) * n
        else:
            raise ValueError(f"unknown tag type {kind}")
        out[key] = t
    return out


def bam_header(file: str) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, reference names and lengths, and the place (in the inflated file) of the first record."""
    held = b""
    for _, raw in _Blocks(file, 0):
        held += raw
        if len(held) < 8 or len(held) < 12 + struct.unpack_from("<i", held, 4)[0]:
            continue
        if held[:4] != b"BAM\x01":
            raise ValueError("not BAM")
        size = struct.unpack_from("<i", held, 4)[0]
        text, at = held[8 : 8 + size].split(b"\0")[0].decode(), 8 + size
        n, at, refs = struct.unpack_from("<i", held, at)[0], at + 4, []
        while len(refs) < n:
            if at + 4 > len(held) or at + 8 + struct.unpack_from("<i", held, at)[0] > len(held):
                break
            size = struct.unpack_from("<i", held, at)[0]
            refs.append((held[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", held, at + 4 + size)[0]))
            at += 8 + size
        if len(refs) == n:
            return text, refs, at
    raise ValueError("the file ends inside its header")


def read_bam_header(file: str) -> tuple[list[tuple[str, dict[str, str]]], list[tuple[str, int]]]:
    """Header records, as :func:`read_header` gives them, and the reference names and lengths of a BAM file."""
    text, refs, _ = bam_header(file)
    return header_records([x for x in text.splitlines() if x.startswith("@")]), refs


class _Blocks:
    """Inflated blocks of a file from the first that starts at ``at`` or behind it, with the place of each in the file."""

    def __init__(self, file: str, at: int, size: int | None = None):
        self.stream, self.at, self.size = ranges.open_file(file), at, size

    def _head(self, held: bytes) -> int | None:
        """Size of the block that ``held`` starts with; None if it starts none."""
        if held[:4] != b"\x1f\x8b\x08\x04" or len(held) < 18:
            return None
        extra, p = struct.unpack_from("<H", held, 10)[0], 12
        while p + 6 <= 12 + extra <= len(held):
            tag, n = held[p : p + 2], struct.unpack_from("<H", held, p + 2)[0]
            if tag == b"BC" and n == 2:
                return struct.unpack_from("<H", held, p + 4)[0] + 1
            p += 4 + n
        return None

    def seek(self) -> int | None:
        """Place of the first block at or behind ``at``: one that inflates to what its checksum says. A block has at most 64 KiB."""
        self.stream.seek(self.at)
        held = self.stream.read(1 << 17)
        p = held.find(b"\x1f\x8b\x08\x04")
        while 0 <= p < 1 << 16:
            size = self._head(held[p:])
            if size and p + size <= len(held):
                try:
                    next(bgzf_blocks(held[p : p + size]))
                    return self.at + p
                except (ValueError, struct.error, zlib.error):
                    pass
            p = held.find(b"\x1f\x8b\x08\x04", p + 1)
        return None

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at, held = self.at, b""
        self.stream.seek(at)
        while True:
            while True:
                size = self._head(held) if len(held) >= 18 else None
                if size is not None and len(held) >= size:
                    break
                more = self.stream.read(1 << 20)
                if not more:
                    if held:
                        raise ValueError("not a BGZF block, or the file ends inside one")
                    return
                held += more
                if size is None and len(held) >= 1 << 17 and self._head(held) is None:
                    raise ValueError("not a BGZF block")
            yield at, next(bgzf_blocks(held[:size]))
            at, held = at + size, held[size:]


def _plausible(b: bytes, at: int, n_refs: int) -> int | None:
    """Size of the record, with its size field, that may start here; None if none can, 0 if its fixed part is not there."""
    if at + 36 > len(b):
        return 0
    size, rid, pos, l_name, _, _, n_cigar, _, l_seq, next_id, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", b, at)
    need = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if size < need or l_seq < 0 or l_name < 1 or size > 1 << 28 or not -1 <= rid < n_refs or not -1 <= next_id < n_refs or pos < -1 or next_pos < -1:
        return None
    name = b[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or not all(33 <= x <= 126 for x in name[:-1])):
        return None
    return size + 4


def _bam_start(file: str, lo: int, hi: int, n_refs: int) -> str:
    """Block and place in it of the first record of a range from which records follow each other; empty if there is none."""
    blocks = _Blocks(file, lo)
    first = blocks.seek()
    if first is None or first >= hi:
        return ""
    held, places, tried = b"", [], 0
    more = iter(_Blocks(file, first))
    while True:
        block = next(more, None)
        if block is not None:
            if block[0] < hi:
                places.append((len(held), block[0], len(block[1])))
            held += block[1]
        end = sum(p[2] for p in places)
        for p in range(tried, end):
            at, good = p, 0
            while good < 8 and (size := _plausible(held, at, n_refs)):
                at, good = at + size, good + 1
            if good == 8 or good and block is None and at == len(held):
                start, place, _ = [x for x in places if x[0] <= p][-1]
                return f"{place}:{p - start}"
            if size == 0 and block is not None and good < 8:
                break  # more is needed to tell
            tried = p + 1
        if block is None or block[0] >= hi and tried >= end:
            return ""


def bam_records(file: str, start: str, hi: int) -> Iterator[tuple[int, int, bytes]]:
    """(block, place in the inflated block, bytes) of records from a place on that start in blocks before ``hi``; the bytes of
    the first record beyond are empty."""
    block, inside = map(int, start.split(":"))
    held, at, marks = b"", inside, []
    for place, raw in _Blocks(file, block):
        marks.append((len(held), place))
        held += raw
        while at + 4 <= len(held):
            size = struct.unpack_from("<i", held, at)[0]
            while len(marks) > 1 and marks[1][0] <= at:
                marks.pop(0)
            if marks[0][1] >= hi:
                yield marks[0][1], at - marks[0][0], b""
                return
            if size < 32:
                raise ValueError("a record is too short")
            if at + 4 + size > len(held):
                break
            yield marks[0][1], at - marks[0][0], held[at + 4 : at + 4 + size]
            at += 4 + size
        if at <= len(held):
            drop = min(at, marks[-1][0])
            held, at, marks = held[drop:], at - drop, [(max(m - drop, 0), p) for m, p in marks if m >= drop or p == marks[-1][1]]
    if at < len(held):
        raise ValueError("the file ends inside a record")


def _bam_record(b: bytes, names: list[str]) -> dict:
    rid, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_id, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", b)
    at = 32
    qname = b[at : at + l_name - 1].decode()
    at += l_name
    cigar = [{"op": OPS[x & 15], "len": x >> 4} for x in struct.unpack_from(f"<{n_cigar}I", b, at)]
    at += 4 * n_cigar
    packed = b[at : at + (l_seq + 1) // 2]
    seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in packed)[:l_seq]
    at += (l_seq + 1) // 2
    qual = b[at : at + l_seq]
    name = lambda i: names[i] if i >= 0 else None
    return {
        "qname": None if qname == "*" else qname, "flag": flag, "rname": name(rid), "pos0": pos, "mapq": mapq, "cigar": cigar, "rnext": name(next_id), "pnext0": next_pos, "tlen": tlen,
        "seq": seq or None, "qual": None if not qual or qual[0] == 0xFF else "".join(chr(q + 33) for q in qual), "tags": _bam_tags(b, at + l_seq, len(b)),
    }


def read_bam(spark: SparkSession, path: str | list[str], range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """Records with (file, block, i), the order in the file: the place of the block in which a record starts, and the
    record's place in the inflated block. A range of a file is searched for a place from which records follow each other,
    and the places are checked against what the range before read (see :mod:`strandspark.sources.ranges`)."""
    schema = to_arrow_schema(StructType.fromDDL("file string, block bigint, i bigint, " + SCHEMA))

    def walk(file: str, size: int, lo: int, hi: int) -> tuple[str, str]:
        _, refs, first = bam_header(file)
        if lo == 0:
            start = ""
            for place, raw in _Blocks(file, 0):
                if first < len(raw):
                    start = f"{place}:{first}"
                    break
                first -= len(raw)
        else:
            start = _bam_start(file, lo, hi, len(refs))
        if not start or int(start.split(":")[0]) >= hi:
            return "", ""
        try:
            for place, inside, data in bam_records(file, start, hi):
                if not data:
                    return start, f"{place}:{inside}"
        except (ValueError, struct.error):
            return start, "none" if lo else ""  # a wrong start, or a malformed file: reading it says so
        return start, ""

    def parse(file: str, size: int, hi: int, start: str):
        import pyarrow as pa

        names = [n for n, _ in bam_header(file)[1]]
        rows = []
        for block, inside, data in bam_records(file, start, hi if hi < size else size + 1):
            if not data:
                break
            r = _bam_record(data, names)
            rows.append({"file": file, "block": block, "i": inside, **r, "tags": list(r["tags"].items())})
            if len(rows) == 4096:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = ranges.indexed(ranges.cut(ranges.files(spark, path), range_bytes), walk)
    return ranges.parsed(found, parse, "file string, block bigint, i bigint, " + SCHEMA)
