"""FASTA, FASTQ, BED, delimited text and reference text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandspark.functions import text as fn
from strandspark.operators import positions
from strandspark.sources import ranges


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_idx, id, extra, seq). Records start at ``>`` or ``;``; a sequence before any header has a null id. Split
    by the line separator ``\\n>``, so a large file is read by many tasks; record_idx counts in file order."""
    parts = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # a header that starts with ; is not split by the reader
    parts = parts.select("file", "block", "at", F.posexplode(F.split(F.regexp_replace("value", r"\r", ""), r"\n(?=;)")).alias("sub", "value"))
    first = (F.col("at") == F.min("at").over(_by("file"))) & (F.col("sub") == 0)
    marked = parts.withColumn("_head", F.when(first & ~F.col("value").rlike(r"^\s*[>;]"), F.lit(False)).otherwise(F.lit(True)))
    body = F.regexp_replace("value", r"^\s*[>;]", "")
    header = F.when(F.col("_head"), F.substring_index(body, "\n", 1))
    seq = F.when(F.col("_head"), F.when(F.instr(body, "\n") > 0, F.substr(body, F.instr(body, "\n") + 1)).otherwise("")).otherwise(F.col("value"))
    names = F.split(F.trim(header), r"\s+")
    out = marked.select("file", "at", "sub", F.get(names, F.lit(0)).alias("id"), F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))).alias("extra"), F.regexp_replace(seq, r"\s", "").alias("seq"))
    out = out.where("NOT (id IS NULL AND seq = '')")
    return out.withColumn("record_idx", F.row_number().over(_by("file").orderBy("at", "sub")) - 1).select("file", "record_idx", "id", "extra", "seq")


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def single_sequence(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The first sequence, or the one with the name."""
    records = read_fasta(spark, path)
    return records.where(F.col("id") == name).limit(1) if name is not None else records.where("record_idx = 0")


def reference_text(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(id, seq) of a file that holds one sequence as plain text; white space and gaps are removed."""
    return spark.read.text(path, wholetext=True).select(F.lit(name).alias("id"), F.regexp_replace("value", r"[\s-]", "").alias("seq"))


def write_fasta(df: DataFrame, path: str, width: int = 70) -> None:
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    head = F.concat_ws(" ", F.concat(F.lit(">"), "id"), F.array_join(F.coalesce("extra", F.expr("cast(array() as array<string>)")), " "))
    df.select(F.concat(F.rtrim(head), F.lit("\n"), wrapped)).write.text(path)


def fastq_records(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """Records of any number of lines: quality ends when it is as long as the sequence."""
    lines = iter(lines)
    for line in lines:
        if not line:
            continue
        if line[0] != "@":
            raise ValueError(f"a record starts with @, not {line[:20]!r}")
        name, seq, qual = line[1:], [], []
        for line in lines:
            if line.startswith("+"):
                break
            seq.append(line)
        have, need = 0, sum(map(len, seq))
        while have < need:
            part = next(lines, None)
            if part is None:
                raise ValueError("the quality is shorter than the sequence")
            qual.append(part)
            have += len(part)
        if have > need:
            raise ValueError("the quality is longer than the sequence")
        yield name, "".join(seq), "".join(qual)


class _Lines:
    """Lines of a file from a place on, with the place of each; ``gz`` files are inflated as they are read."""

    def __init__(self, file: str, at: int):
        self.raw, self.at = ranges.open_file(file), at
        if file.endswith(".gz"):
            import gzip

            self.stream = gzip.GzipFile(fileobj=self.raw)
        else:
            self.raw.seek(at)
            self.stream = self.raw
        self.held, self.done = b"", False

    def __iter__(self) -> Iterator[tuple[int, str]]:
        place, held = self.at, b""
        while True:
            block = self.stream.read(1 << 20)
            held += block
            lines = held.split(b"\n")
            held = lines.pop() if block else b""
            for x in lines:
                yield place, x.rstrip(b"\r").decode()
                place += len(x) + 1
            if not block:
                return


def _placed(lines: Iterator[tuple[int, str]]) -> Iterator[tuple[int, tuple[str, str, str]]]:
    """Records with the places at which they start, and at last the place at which the lines end."""
    state = {"at": None, "last": 0}

    def texts() -> Iterator[str]:
        for place, text in lines:
            state["last"] = place + len(text.encode()) + 1
            if state["at"] is None and text:
                state["at"] = place
            yield text

    for record in fastq_records(texts()):
        yield state["at"], record
        state["at"] = None


def _fastq_start(file: str, lo: int) -> int | None:
    """The first place from ``lo`` on from which four records, or all up to the end, can be read."""
    lines = []
    for place, text in _Lines(file, lo - 1 if lo else 0):
        if lo and not lines and place < lo:  # the rest of a line that starts before
            continue
        lines.append((place, text))
        if len(lines) % 512 == 0 or sum(len(t) for _, t in lines[-512:]) > 1 << 22:
            if (found := _sync(lines, False)) is not None:
                return found
    return _sync(lines, True)


def _sync(lines: list[tuple[int, str]], whole: bool) -> int | None:
    for i, (place, text) in enumerate(lines):
        if not text.startswith("@"):
            continue
        good = 0
        try:
            for _, (_, seq, _) in _placed(iter(lines[i:])):
                if not re.fullmatch(r"[A-Za-z.*-]*", seq):
                    raise ValueError
                good += 1
                if good == 4:
                    return place
        except ValueError:
            # what ends too early may go on beyond the lines held
            continue
        if whole:
            return place
    return None


def read_fastq(spark: SparkSession, path: str | list[str], range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """(file, record_idx, id, seq, qual). A quality line may start with @ and records may have many lines, so a range of a
    file is searched for a place from which records can be read, and the places are checked against what the range before
    read (see :mod:`strandspark.sources.ranges`). A ``.gz`` file is one range, inflated as it is read."""

    def walk(file: str, size: int, lo: int, hi: int) -> tuple[str, str]:
        if lo == 0 and (hi >= size or file.endswith(".gz")):
            return ("0", "") if size else ("", "")
        start = 0 if lo == 0 else _fastq_start(file, lo)
        if start is None or start >= hi:
            return "", ""
        try:
            for place, _ in _placed(iter(_Lines(file, start))):
                if place >= hi:
                    return str(start), str(place)
        except ValueError:
            if lo == 0:  # the file is malformed; reading it says so
                return "0", ""
            return str(start), "none"
        return str(start), ""

    def parse(file: str, size: int, hi: int, start: str):
        rows: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["file", "_at", "id", "seq", "qual"])

        for place, r in _placed(iter(_Lines(file, int(start)))):
            if place >= hi and hi < size:
                break
            rows.append((file, place, *r))
            if len(rows) == 4096:
                yield batch()
                rows = []
        if rows:
            yield batch()

    found = ranges.indexed(ranges.cut(ranges.files(spark, path), range_bytes, ".gz"), walk)
    rows = ranges.parsed(found, parse, "file string, _at bigint, id string, seq string, qual string")
    numbered = positions.numbered(rows, ["_at"], "record_idx", ["file"])
    return numbered.select("file", (F.col("record_idx") - 1).alias("record_idx"), "id", "seq", "qual")


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")).write.text(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, begin, end), half-open; further columns are ignored, rows that lack one or have malformed numbers are an error."""
    lines = spark.read.text(path).where(r"NOT value RLIKE '^(#|track|browser|\\s*$)'").select(F.split("value", "\t").alias("c"))
    b, e = F.get("c", F.lit(1)).try_cast("bigint"), F.get("c", F.lit(2)).try_cast("bigint")
    bad = F.raise_error(F.concat(F.lit("not a region: "), F.array_join("c", "|"))).cast("bigint")
    return lines.select(F.get("c", F.lit(0)).alias("chrom"), F.coalesce(b, bad).alias("begin"), F.coalesce(e, bad).alias("end"))


ERROR = "struct<field:int,position:int,message:string>"


def delimited_fields(
    rows: DataFrame, schema: StructType | str, delimiter: str | list[str] = "\t", *, value: str = "value", keep: tuple[str, ...] = (), tag: str | None = None,
    branches: dict[str, tuple[int, str]] | None = None, optional: int = 0, repeating: str | None = None, printable: tuple[str, ...] = (), mode: str = "FAILFAST",
) -> DataFrame:
    """Declared typed fields of delimited text in the column ``value``; the columns ``keep`` go with them.

    ``delimiter``: one, or several of which each ends a field. Fields named ``_skip…`` are left out. A ``char`` field (declared
    ``char(1)``) is exactly one character. With ``tag``, each branch (tag value -> field index, type) is a nullable column
    ``<tag value>_value`` filled for rows of that tag. The last ``optional`` fields may be missing. ``repeating``: the last field is an
    array, whose elements are divided by this text. ``printable`` fields hold the characters from space to tilde only.

    ``mode``: FAILFAST raises at a row that does not fit; PERMISSIVE sets its fields that do not to null and adds ``_error``, the
    first such field (from 0), its place in the text (from 1) and what is wrong."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parts = [delimiter] if isinstance(delimiter, str) else delimiter
    pattern = "|".join(r"\Q" + d.replace(r"\E", r"\E\\E\Q") + r"\E" for d in sorted(parts, key=len, reverse=True))
    rows = rows.select(*keep, F.col(value).alias("_v"), F.split(value, pattern).alias("c"), F.regexp_extract_all(F.col(value), F.lit(f"({pattern})"), F.lit(1)).alias("_d"))
    place = lambda i: 1 + F.aggregate(F.slice("c", 1, i), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice("_d", 1, i), F.lit(0), lambda n, x: n + F.length(x)) if i else F.lit(1)
    out, errors, n = [], [], len(schema.fields)
    for i, f in enumerate(schema.fields):
        skip, kind = f.name.startswith("_skip"), f.dataType.simpleString()
        v = F.get("c", F.lit(i))
        if repeating is not None and i == n - 1:
            inner = kind[len("array<") : -1] if kind.startswith("array<") else "string"
            # the text from this field on, divided by the repeating delimiter
            rest = F.when(F.size("c") > i, F.substr("_v", place(i)))
            items = F.split(rest, r"\Q" + repeating + r"\E")
            typed, wrong = F.transform(items, lambda x: _cast(x, inner)), F.exists(items, lambda x: _wrong(x, inner, False))
        else:
            typed, wrong = _cast(v, kind), _wrong(v, kind, f.name in printable)
        missing = F.lit(False) if i >= n - optional else F.size("c") <= i
        if not skip or i < n - optional:
            wrong = F.lit(False) if skip else F.coalesce(wrong, F.lit(False))
            text = F.when(missing, "the field is missing").when(wrong, F.concat(F.lit(f"not {kind}: "), F.coalesce(v, F.lit(""))))
            errors.append(F.when(text.isNotNull(), F.struct(F.lit(i).alias("field"), F.when(missing, F.length("_v") + 1).otherwise(place(i)).cast("int").alias("position"), text.alias("message"))))
        if not skip:
            out.append(typed.alias(f.name))
        if f.name == tag:
            for at, t in (branches or {}).values():
                w = F.get("c", F.lit(at))
                chosen = F.lit(False)
                for k, (a2, t2) in branches.items():
                    if (a2, t2) == (at, t):
                        chosen = chosen | (v == k)
                bad = F.coalesce(chosen, F.lit(False)) & F.coalesce(_wrong(w, t, False), F.lit(False))
                errors.append(F.when(bad, F.struct(F.lit(at).alias("field"), place(at).cast("int").alias("position"), F.concat(F.lit(f"not {t}: "), w).alias("message"))))
            for k, (at, t) in (branches or {}).items():
                out.append(F.when(v == k, _cast(F.get("c", F.lit(at)), t)).alias(f"{k}_value"))
    if repeating is None and n:
        surplus = F.size("c") > F.lit(max([n, *(at + 1 for at, _ in (branches or {}).values())]))
        errors.append(F.when(surplus, F.struct(F.lit(n).alias("field"), place(n).cast("int").alias("position"), F.lit("a field too many").alias("message"))))
    error = F.coalesce(*errors, F.lit(None).cast(ERROR)).cast(ERROR)
    if mode == "PERMISSIVE":
        return rows.select(*keep, *out, error.alias("_error"))
    message = F.concat(F.lit("field "), F.col("_error.field"), F.lit(" at "), F.col("_error.position"), F.lit(": "), F.col("_error.message"))
    checked = rows.withColumn("_error", error).withColumn("c", F.when(F.col("_error").isNull(), F.col("c")).otherwise(F.raise_error(message).cast("array<string>")))
    return checked.select(*keep, *out)


def _cast(v: Column, kind: str) -> Column:
    if kind == "boolean":
        return fn.parse_boolean(v, strict=False)
    if kind.startswith("char("):
        return F.when(F.length(v) == int(kind[5:-1]), v)
    return v if kind == "string" else v.try_cast(kind)


def _wrong(v: Column, kind: str, printable: bool) -> Column:
    """Whether a text that is there is no value of its type."""
    bad = v.isNotNull() & _cast(v, kind).isNull()
    return bad | ~fn.only_printable(v) if printable else bad


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, delimiter: str | list[str] = "\t", **options) -> DataFrame:
    """Delimited text files; see :func:`delimited_fields`. Empty lines are left out."""
    return delimited_fields(spark.read.text(path).where("value <> ''"), schema, delimiter, **options)
