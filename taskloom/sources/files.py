"""Readers and writers of task and session files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what a storage type of a warehouse becomes; nested types first.
TYPES = (
    (r"\[\]$|^STRUCT|^MAP|^UNION|^JSON|^LIST", "string"), (r"^BOOL", "boolean"), (r"^U?HUGEINT", "decimal(38,0)"), (r"^UBIGINT", "decimal(20,0)"), (r"^U?(?:TINY|SMALL|BIG)?INT(?!ERVAL)", "bigint"),
    (r"^FLOAT|^REAL|^DOUBLE", "double"), (r"^DECIMAL|^NUMERIC", "decimal"), (r"^DATE$", "date"), (r"^TIMESTAMP|^DATETIME", "timestamp"), (r"^BLOB|^BYTEA|^VARBINARY", "binary"), (r"^TIME|^INTERVAL|^VARCHAR|^CHAR|^TEXT|^UUID|^BIT|^ENUM", "string"),
)


def mapped_type(types: DataFrame) -> DataFrame:
    """types (source) with target: the Spark type of a warehouse's type; what is not known becomes string."""
    s = F.upper(F.trim("source"))
    out = F.lit("string")
    for pattern, target in reversed(TYPES):
        out = F.when(s.rlike(pattern), F.lower("source") if target == "decimal" else F.lit(target)).otherwise(out)
    return types.withColumn("target", out)


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """One object a line, blank lines skipped. strict: a bad line or a missing required field is an error; else such lines are kept in _corrupt_record."""
    if strict:
        d = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        for c in required:
            d = d.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing {c}")).cast(d.schema[c].dataType)).otherwise(F.col(c)))
        return d
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Session logs, plain or compressed by a codec of Hadoop's, with path and seq; lines that do not parse have a null event."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name()).withColumn("seq", F.monotonically_increasing_id())
    return lines.where(F.trim("value") != "").select("path", "seq", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("event"))


def read_zstd_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of zstd files, in Python, as Hadoop's codec needs native code; a file that does not unpack gives no lines."""
    from collections.abc import Iterator

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import zstandard

        for f in batches:
            for name, content in zip(f["path"], f["content"], strict=True):
                try:
                    reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)), encoding="utf-8", errors="replace")
                    part: list = []
                    for i, line in enumerate(reader):
                        part.append((name, i, line.rstrip("\n")))
                        if len(part) == 10_000:
                            yield pd.DataFrame(part, columns=["path", "line_no", "line"])
                            part = []
                    if part:
                        yield pd.DataFrame(part, columns=["path", "line_no", "line"])
                except zstandard.ZstdError:
                    continue

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, line_no long, line string")


def read_ids(spark: SparkSession, path: str, header: str = "instance_id") -> DataFrame:
    """(instance_id): the first column of a CSV, without a header line and without a prefix sf_."""
    first = spark.read.csv(path).select(F.col("_c0").alias("v"))
    return first.where((F.col("v") != header) & F.col("v").isNotNull()).select(F.regexp_replace("v", "^sf_", "").alias("instance_id"))


def read_json_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents under a folder, one a file, hidden copies (._*) and broken files skipped."""
    d = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*.json").json(path)
    return d.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_jdbc(spark: SparkSession, url: str, query: str, driver: str, seconds: int = 60) -> DataFrame:
    """A query of another database by its JDBC driver, with a deadline; read-only by the connection."""
    return spark.read.format("jdbc").option("url", url).option("driver", driver).option("query", query).option("queryTimeout", seconds).load()


def doc_blocks(texts: DataFrame) -> DataFrame:
    """(name, description): docs blocks of texts (path, text); the first block of a name that says something."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)\{%\s*docs\s+(\w+)\s*%\}(.*?)\{%\s*enddocs\s*%\}"), F.lit(0))
    d = texts.select("path", F.posexplode(blocks).alias("i", "b"))
    d = d.select("path", "i", F.regexp_extract("b", r"\{%\s*docs\s+(\w+)", 1).alias("name"), F.trim(F.regexp_replace(F.regexp_replace("b", r"\{%.*?%\}", ""), r"^\s+|\s+$", "")).alias("description"))
    return d.where("description <> ''").groupBy("name").agg(F.min_by("description", F.struct("path", "i")).alias("description"))


def described(text: str | None) -> list[tuple[str, str, str | None, str]]:
    """(kind, table, column, description) of a YAML file of models, seeds, snapshots and sources; column is null for a table's own.

    What is read of YAML is its shape in such files: lists of `- name:` under keys, by
    indentation, with `description:` as a plain or quoted text on its line, or as a block of
    deeper lines after > or |. Anything else is passed over. A source's tables count, the source does not.
    """
    out: list[tuple[str, str, str | None, str]] = []
    keys: list[tuple[int, str]] = []  # open keys and names, by indentation
    lines = (text or "").split("\n")
    at, early = 0, ""
    while at < len(lines):
        raw = lines[at]
        at += 1
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        indent = len(raw) - len(raw.lstrip())
        while line.startswith("- "):
            keys = [k for k in keys if k[0] < indent or k[0] == indent and k[1][0] not in "-="] + [(indent, "-")]
            line, indent, early = line[2:].lstrip(), indent + 2, ""
        key, sep, value = line.partition(":")
        if not sep or not key.replace("_", "").isalnum():
            continue
        keys = [k for k in keys if k[0] < indent]
        value = value.strip()
        if key == "description" and value[:1] in (">", "|"):
            block = []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip()) > indent):
                block.append(lines[at].strip())
                at += 1
            value = (" " if value[0] == ">" else "\n").join(block).strip()
        elif value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        item = next((i for i in range(len(keys) - 1, -1, -1) if keys[i][1][0] in "-="), None)
        if item is None or key not in ("name", "description"):
            if not value:
                keys.append((indent, key))
            continue
        if key == "name":
            keys[item] = keys[item][0], f"={value}"
            value, early = early, ""  # a description before the name
        elif keys[item][1] == "-":
            early = value
            continue
        chain = [k for _, k in keys]
        names = [k[1:] for k in chain if k.startswith("=")]
        tables = names[1:] if chain[0] == "sources" else names
        if value and chain[0] in ("models", "seeds", "snapshots", "sources") and 1 <= len(tables) <= 2:
            out.append((chain[0], tables[0], tables[1] if len(tables) == 2 else None, value))
    return out


def harvested(yaml: DataFrame, docs: DataFrame) -> DataFrame:
    """(table, column, description) of YAML files (path, text) and docs blocks (name, description): the first that says something, in the order of path and place.

    A description that is a call of doc() is that of the block it names; one whose block is
    not there says nothing.
    """
    @F.pandas_udf("array<struct<kind:string,table:string,column:string,description:string>>")
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "table", "column", "description"), d, strict=True)) for d in described(t)] for t in texts])

    d = yaml.select("path", F.posexplode(parsed("text")).alias("i", "d")).select("path", "i", "d.table", "d.column", "d.description")
    d = d.withColumn("block", F.regexp_extract("description", r"""^\{\{\s*doc\(\s*['"]([^'"]+)['"]\s*\)\s*\}\}$""", 1))
    d = d.join(docs.select(F.col("name").alias("block"), F.col("description").alias("said")), "block", "left")
    d = d.withColumn("description", F.when(F.col("block") == "", F.col("description")).otherwise(F.col("said"))).where("trim(description) <> ''")
    return d.groupBy("table", "column").agg(F.min_by("description", F.struct("path", "i")).alias("description"))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, replaced as a whole by the committer."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_catalog(spark: SparkSession, documents: dict[str, DataFrame], path: str) -> DataFrame:
    """Documents (k) as JSON lines in a folder each, and a manifest (name, rows, digest) that is written last, of what is read back."""
    parts = []
    for name, df in documents.items():
        write_jsonl(df, f"{path}/{name}")
        back = spark.read.schema(df.schema).json(f"{path}/{name}")
        parts.append(back.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ","), 256).alias("digest")))
    manifest = parts[0]
    for p in parts[1:]:
        manifest = manifest.unionByName(p)
    write_jsonl(manifest, f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for small results."""
    df.coalesce(1).write.mode("overwrite").option("lineSep", "\n").csv(path, header=True)


def write_verified(df: DataFrame, path: str, key: str) -> int:
    """JSON lines, read again: as many rows, and none without a key. Returns their number."""
    write_jsonl(df, path)
    n, keys = df.sparkSession.read.schema(df.schema).json(path).agg(F.count("*"), F.count(key)).first()
    if n != df.count() or keys != n:
        raise ValueError(f"{path}: {n} rows, {keys} keys")
    return n


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report of a small result."""
    rows = df.limit(most).collect()
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""])
