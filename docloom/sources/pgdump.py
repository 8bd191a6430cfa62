"""Plain-format relational dumps (CREATE TABLE, COPY, ALTER TABLE, CREATE INDEX) as one DataFrame of strings a table.

Rows stay distributed: the driver sees statements and the COPY blocks' borders only. A line's place is the start of
its file block and its number within it, so the order of the rows is the dump's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.errors import BadDump

NAME = r'(?:"[^"]+"|[A-Za-z_][A-Za-z0-9_$]*)'
QUALIFIED = rf"(?:{NAME}\.)?({NAME})"
COPY = re.compile(rf"^COPY {QUALIFIED}\s*(?:\(([^)]*)\))? FROM stdin;\s*$", re.I)
POSITION = "_position"


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    parent_columns: list[str]


@dataclass
class Index:
    fields: list[str]
    directions: list[int]
    unique: bool = False


@dataclass
class Table:
    name: str
    columns: dict[str, str] = field(default_factory=dict)  # name to SQL type
    not_null: list[str] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    rows: DataFrame | None = None  # strings, with POSITION


def bare(name: str) -> str:
    name = name.strip()
    return name[1:-1] if name.startswith('"') else name


def listed(text: str) -> list[str]:
    return [bare(x) for x in text.split(",")]


def decoded(text: Column) -> Column:
    """A COPY field: \\N is null; \\t, \\n, \\r, \\b, \\f, \\v and \\\\ are characters, any other \\x is x.

    Pairs of backslashes are taken apart first, so that each other backslash begins an escape.
    """
    piece = lambda p: F.regexp_replace(p, r"\\(.)", "$1")
    for letter, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f"), ("v", "\x0b")):
        piece = _after(letter, char, piece)
    return F.when(text != "\\N", F.array_join(F.transform(F.split(text, r"\\\\"), lambda p: piece(p)), "\\"))


def _after(letter: str, char: str, following):
    return lambda p: following(F.replace(p, F.lit("\\" + letter), F.lit(char)))


def statements(text: str) -> list[str]:
    """Split at semicolons outside quotes; comments go."""
    out, own = [], []
    for part in re.findall(r"--[^\n]*|'(?:[^']|'')*'|\"[^\"]*\"|;|[^;'\"-]+|-", text):
        if part == ";":
            out.append("".join(own).strip())
            own = []
        elif not part.startswith("--"):
            own.append(part)
    return [s for s in [*out, "".join(own).strip()] if s]


def split_top(text: str) -> list[str]:
    """Split at commas outside parentheses and quotes."""
    out, depth, own, quoted = [], 0, "", ""
    for c in text:
        if quoted:
            quoted = "" if c == quoted else quoted
        elif c in "'\"":
            quoted = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        if c == "," and not depth and not quoted:
            out.append(own.strip())
            own = ""
        else:
            own += c
    return [*out, own.strip()] if own.strip() else out


def _constraint(t: Table, text: str) -> bool:
    if m := re.match(r"(?:CONSTRAINT \S+ )?PRIMARY KEY \(([^)]*)\)", text, re.I):
        t.primary_key = listed(m[1])
    elif m := re.match(r"(?:CONSTRAINT \S+ )?UNIQUE(?: NULLS NOT DISTINCT)? \(([^)]*)\)", text, re.I):
        t.unique.append(listed(m[1]))
    elif m := re.match(rf"(?:CONSTRAINT \S+ )?FOREIGN KEY \(([^)]*)\) REFERENCES {QUALIFIED}(?:\s*\(([^)]*)\))?", text, re.I):
        t.foreign_keys.append(ForeignKey(listed(m[1]), bare(m[2]), listed(m[3]) if m[3] else []))
    else:
        return bool(re.match(r"CONSTRAINT|CHECK|EXCLUDE|LIKE", text, re.I))
    return True


def schema(text: str) -> dict[str, Table]:
    """Tables with their keys and indexes, from the statements that aren't rows."""
    tables: dict[str, Table] = {}
    for s in statements(text):
        flat = re.sub(r"\s+", " ", s)
        if re.match(r"INSERT INTO", flat, re.I):
            raise BadDump("rows as INSERT; dump with COPY")
        if re.match(r"CREATE (?:UNLOGGED |FOREIGN )?TABLE", flat, re.I):
            if re.search(r"\bPARTITION (?:BY|OF)\b|\bINHERITS\b", flat, re.I):
                raise BadDump("partitioned and inheriting tables are not supported")
            m = re.match(rf"CREATE (?:UNLOGGED |FOREIGN )?TABLE (?:IF NOT EXISTS )?{QUALIFIED} \((.*)\)", flat, re.I)
            if not m:
                raise BadDump(f"cannot read {flat[:80]!r}")
            t = tables[bare(m[1])] = Table(bare(m[1]))
            for part in split_top(m[2]):
                if _constraint(t, part):
                    continue
                c = re.match(rf"({NAME}) (.+?)(?= (?:NOT NULL|NULL|DEFAULT|PRIMARY KEY|UNIQUE|REFERENCES|COLLATE|GENERATED|CONSTRAINT|CHECK)\b|$)", part, re.I)
                if not c:
                    raise BadDump(f"cannot read column {part[:80]!r}")
                t.columns[bare(c[1])] = c[2].lower()
                if re.search(r"\bNOT NULL\b", part, re.I):
                    t.not_null.append(bare(c[1]))
                if re.search(r"\bPRIMARY KEY\b", part, re.I):
                    t.primary_key = [bare(c[1])]
                if re.search(r"\bUNIQUE\b", part, re.I):
                    t.unique.append([bare(c[1])])
                if r := re.search(rf"\bREFERENCES {QUALIFIED}\s*\(([^)]*)\)", part, re.I):
                    t.foreign_keys.append(ForeignKey([bare(c[1])], bare(r[1]), listed(r[2])))
        elif m := re.match(rf"ALTER TABLE (?:ONLY )?(?:IF EXISTS )?{QUALIFIED} (.*)", flat, re.I):
            if re.search(r"ATTACH PARTITION", m[2], re.I):
                raise BadDump("partitioned tables are not supported")
            own = tables.get(bare(m[1]))
            for part in split_top(m[2]) if own else ():
                if re.match(r"ADD ", part, re.I):
                    _constraint(own, part[4:])
        elif m := re.match(rf"CREATE (UNIQUE )?INDEX (?:\S+ )?ON (?:ONLY )?{QUALIFIED} (?:USING \w+ )?\((.*?)\)(?: WHERE .*)?$", flat, re.I):
            own, parts = tables.get(bare(m[2])), split_top(m[3])
            if own and not re.search(r" WHERE ", flat, re.I) and all(re.match(rf"{NAME}(?: (?:ASC|DESC))?(?: NULLS (?:FIRST|LAST))?$", p, re.I) for p in parts):
                index = Index([bare(p.split(" ")[0]) for p in parts], [-1 if re.search(r" DESC", p, re.I) else 1 for p in parts], bool(m[1]))
                own.unique.append(index.fields) if index.unique else own.indexes.append(index)
    for t in tables.values():
        for fk in t.foreign_keys:
            if not fk.parent_columns and fk.table in tables:
                fk.parent_columns = tables[fk.table].primary_key
    return tables


def read_dump(spark: SparkSession, path: str) -> dict[str, Table]:
    lines = spark.read.text(path, lineSep="\n").select(F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    marks = lines.filter(F.col("line").rlike(r"^(?:COPY .* FROM stdin;\s*|\\\.)$")).orderBy("at").collect()
    blocks, open_ = [], None
    for m in marks:
        copy = COPY.match(m["line"])
        if open_ is None and copy:
            open_ = (copy, m["at"])
        elif open_ is not None and m["line"] == "\\.":
            blocks.append((bare(open_[0][1]), listed(open_[0][2]) if open_[0][2] else None, open_[1], m["at"]))
            open_ = None
    if open_ is not None:
        raise BadDump("a COPY block has no end")
    place = lambda at: F.struct(F.lit(at["block"]).cast("bigint").alias("block"), F.lit(at["n"]).cast("bigint").alias("n"))
    within = [(F.col("at") >= place(start)) & (F.col("at") <= place(end)) for *_, start, end in blocks]
    outside = lines
    for inside in within:
        outside = outside.filter(~inside)
    if not outside.filter(F.upper("line").startswith("INSERT INTO ")).isEmpty():  # else all rows would come to the driver
        raise BadDump("rows as INSERT; dump with COPY")
    tables = schema("\n".join(r["line"] for r in outside.orderBy("at").collect()))
    for name, columns, start, end in blocks:
        own = tables.get(name)
        if own is None:
            raise BadDump(f"rows of an unknown table {name!r}")
        columns = columns or list(own.columns)
        fields = lines.filter((F.col("at") > place(start)) & (F.col("at") < place(end))).select("at", F.split("line", "\t").alias("f"))
        if not fields.filter(F.size("f") != len(columns)).isEmpty():
            raise BadDump(f"a row of {name} has the wrong number of fields")
        rows = fields.select(F.col("at").alias(POSITION), *[decoded(F.get("f", F.lit(i))).alias(c) for i, c in enumerate(columns)])
        own.rows = rows.select(POSITION, *[F.col(f"`{c}`") if c in columns else F.lit(None).cast("string").alias(c) for c in own.columns])
    for t in tables.values():
        if t.rows is None:
            t.rows = spark.createDataFrame([], ", ".join([f"{POSITION} struct<block:bigint,n:bigint>", *(f"`{c}` string" for c in t.columns)]))
    return tables
