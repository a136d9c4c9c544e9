"""Writers: staged and validated publishing, upserts, deterministic bundles, blind packs."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.curation import latest


def publish(tables: Mapping[str, DataFrame], root: str, validate: Callable[[Mapping[str, DataFrame]], None] | None = None) -> str:
    """Write all tables below a new version folder, read them back, validate, and only then point
    ``root/CURRENT`` at it. A failure leaves the earlier version in place. Returns the version."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    staged = {name: spark.read.parquet(f"{root}/{version}/{name}") for name in tables}
    if validate:
        validate(staged)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    pointer, fresh = path(f"{root}/CURRENT"), path(f"{root}/CURRENT.{version}")
    out = pointer.getFileSystem(spark._jsc.hadoopConfiguration()).create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    # One rename takes the place of the old pointer: there is no moment without a published version.
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), spark._jsc.hadoopConfiguration())
    files.rename(files.makeQualified(fresh), files.makeQualified(pointer), overwrite)
    return version


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = spark.read.text(f"{root}/CURRENT").first()["value"]
    return spark.read.parquet(f"{root}/{version}/{name}")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column], ignore: bool = False) -> DataFrame:
    """The table after an upsert: the latest row of each key by ``order``, or the first with ``ignore``."""
    return latest(existing.unionByName(incoming), keys, order, first=ignore)


def without_user(tables: Mapping[str, tuple[DataFrame, str]], user: object) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the rows of a user, and how many rows that were by table."""
    kept, counts = {}, None
    for name, (df, key) in tables.items():
        gone = F.coalesce(F.col(key) == F.lit(user), F.lit(False))
        kept[name] = df.where(~gone)
        n = df.where(gone).agg(F.lit(name).alias("table"), F.count("*").alias("deleted"))
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def canonical_lines(df: DataFrame, order: Sequence[str]) -> list[str]:
    """Rows of a table that fits on the driver, as JSON with sorted keys."""
    return [json.dumps(json.loads(r[0]), sort_keys=True, ensure_ascii=False, separators=(",", ":")) for r in df.orderBy(*order).select(F.to_json(F.struct("*"))).toLocalIterator()]


def bundle(files: Mapping[str, Sequence[str]]) -> bytes:
    """A tar of text files that is the same for the same content: fixed order, owners and times, and a
    manifest with the SHA-256 of each file."""
    data = {name: ("\n".join(lines) + "\n").encode() for name, lines in sorted(files.items())}
    manifest = {name: hashlib.sha256(b).hexdigest() for name, b in data.items()}
    data["MANIFEST.json"] = json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name, b in sorted(data.items()):
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(b), 0o644
            tar.addfile(info, io.BytesIO(b))
    return out.getvalue()


def verify_bundle(content: bytes) -> list[str]:
    """Names of files whose hash differs from the manifest, or that only one of both has."""
    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
        data = {m.name: tar.extractfile(m).read() for m in tar.getmembers() if m.isfile()}
    manifest = json.loads(data.pop("MANIFEST.json", b"{}"))
    return sorted({*manifest, *data} - {n for n, b in data.items() if manifest.get(n) == hashlib.sha256(b).hexdigest()})


def blind_pack(items: DataFrame, key: str, shown: Sequence[str], marks: Sequence[str], seed: str) -> DataFrame:
    """Items in hash order with empty mark columns, without anything else that could tell raters more."""
    order = F.sha2(F.concat_ws("\x00", F.lit(seed), F.col(key).cast("string")), 256)
    return items.select(key, *shown).distinct().orderBy(order).select(key, *shown, *(F.lit(None).cast("string").alias(m) for m in marks))
