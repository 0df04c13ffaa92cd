"""Feeds: sessions of another home, captured as verified generations and read beside the native ones.

A capture is a manifest table (path, size, mtime, sha256) made from two listings of the
files: what changed between them, or ends in an unfinished record, keeps its entry of the
previous generation or is left out.
"""

from __future__ import annotations

import fcntl
import os
import re
import shutil
import stat
from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import manifest_diff
from ..operators.state import SESSION_KEY, one
from . import jsonl

# The version and origin of a manifest, and the form of a generation's name.
VERSION, ORIGIN = 1, "desktop"
GENERATION = re.compile(r"[a-zA-Z0-9_-]{8,80}")


# -- places


def translate(locator: Column, old: str, new: str) -> Column:
    """A place below one root as the same place below another; one outside of the root is an error."""
    rest = F.substring(locator, F.lit(len(old) + 1), F.length(locator))
    inside = locator.startswith(old) & ((rest == "") | rest.startswith("/") | rest.startswith("#"))
    moved = F.concat(F.lit(new), rest)
    return F.when(locator.isNull(), F.lit(None).cast("string")).when(inside, moved).otherwise(F.raise_error(F.concat(F.lit(f"place outside of {old}: "), locator)).cast("string"))


def with_origin(references: DataFrame, origin: str, physical: str, logical: str, stable: str | None = None) -> DataFrame:
    """References with ``origin``, the place by its stable name, and ``logical_locator``, its place in the home it came from."""
    place = F.col("locator")
    return references.select(*[translate(place, physical, stable or physical).alias(c) if c == "locator" else F.col(c) for c in references.columns], F.lit(origin).alias("origin"), translate(place, physical, logical).alias("logical_locator"))


def physical_places(references: DataFrame, physical: str, logical: str, stable: str | None = None) -> DataFrame:
    """The way back: places by stable or logical name as files that can be read."""
    at = F.col("locator")
    moved = F.when(at.startswith(physical), at)
    for root in (stable, logical):
        if root and root != physical:
            moved = moved.when(at.startswith(root), translate(F.when(at.startswith(root), at), root, physical))
    return references.withColumn("locator", moved.otherwise(at))


def union_adapters(*parts: DataFrame) -> DataFrame:
    """References of all adapters, native and of feeds; a column that some lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def promoted(references: DataFrame, ids: DataFrame, local: str) -> DataFrame:
    """References without feed copies of promoted sessions: ``ids(source, native_session_id)``.

    A promoted session that the local origin does not have is an error, before anything changes.
    """
    ids = ids.select(*SESSION_KEY).distinct()
    lost = ids.join(references.where(F.col("origin") == local), list(SESSION_KEY), "left_anti").first()
    if lost:
        raise ValueError(f"promoted session {lost[0]}/{lost[1]} is absent from {local}")
    return references.join(ids.withColumn("_promoted", F.lit(True)), list(SESSION_KEY), "left").where((F.col("origin") == local) | F.col("_promoted").isNull()).drop("_promoted")


def aliased(references: DataFrame, aliases: DataFrame) -> DataFrame:
    """References by the session that their place was known as before: ``aliases(source, alias, native_session_id)``."""
    known = one(aliases.select("source", F.col("alias").alias("locator"), F.col("native_session_id").alias("_known")), ["source", "locator"])
    got = references.join(known, ["source", "locator"], "left")
    return got.select(*[F.coalesce("_known", c).alias(c) if c == "native_session_id" else F.col(c) for c in references.columns])


# -- capture


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path`` below the root, ``size``, ``mtime`` of its JSON-lines files; no content is read."""
    found = jsonl.files(spark, root).select("path", "length", "modificationTime")
    return found.select(_below(root), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def _below(root: str) -> Column:
    return F.regexp_replace("path", "^(?:file:)?/*" + re.escape(os.path.abspath(root).lstrip("/")) + "/", "").alias("path")


def read(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``size``, ``mtime``, ``sha256``, ``complete`` and ``malformed`` of the files as they are read."""
    found = jsonl.files(spark, root)
    text = F.col("content").cast("string")
    whole = F.forall(F.filter(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != ""), lambda x: F.try_parse_json(x).isNotNull())
    return found.select(_below(root), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), ((F.col("length") == 0) | text.endswith("\n")).alias("complete"), (text.endswith("\n") & ~whole).alias("malformed"))


def capture(before: DataFrame, files: DataFrame, after: DataFrame, previous: DataFrame) -> DataFrame:
    """Manifest rows ``path``, ``size``, ``mtime``, ``sha256``, ``verdict``.

    ``before`` and ``after`` are listings around the reading of ``files``.  A file is
    captured if all three agree and it ends in a whole record; else it is deferred to
    its entry in ``previous`` (a manifest), or omitted.  What the previous generation has
    and the listing lacks is deferred as well.  A whole record that does not parse is an
    error.
    """
    a, z = (df.select("path", F.col("size").alias(f"{k}_size"), F.col("mtime").alias(f"{k}_mtime")) for df, k in ((before, "a"), (after, "z")))
    old = previous.select("path", *[F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "sha256")], F.lit(True).alias("known"))
    got = a.join(files, "path", "left").join(z, "path", "left").join(old, "path", "full_outer")
    stable = F.lit(True)
    for c in ("size", "mtime"):
        stable = stable & (F.col(c) == F.col(f"a_{c}")) & (F.col(c) == F.col(f"z_{c}"))
    good = F.coalesce(stable & F.col("complete"), F.lit(False))
    bad = good & F.col("malformed")
    verdict = F.when(bad, F.raise_error(F.concat(F.lit("malformed record in "), F.col("path"))).cast("string")).when(good, "captured").when(F.col("known"), "deferred").otherwise("omitted")
    values = [F.when(F.col("verdict") == "captured", F.col(c)).when(F.col("verdict") == "deferred", F.col(f"old_{c}")).alias(c) for c in ("size", "mtime", "sha256")]
    return got.withColumn("verdict", verdict).select("path", *values, "verdict")


def verify(manifest: DataFrame, observed: DataFrame) -> None:
    """Are the observed files those of the manifest, byte for byte, and no others?"""
    wrong = manifest_diff(manifest.where("verdict <> 'omitted'") if "verdict" in manifest.columns else manifest, observed, "path", "size", "mtime", "sha256").first()
    if wrong:
        raise ValueError(f"the feed does not match its manifest: {wrong['path']} {wrong['change']}")


def check_manifest(manifest: dict, home: str, directory: str) -> dict:
    """A manifest's head, if it is that of a completed generation of a home."""
    wanted = {"version": VERSION, "origin": ORIGIN, "sourceHome": home, "generation": os.path.basename(directory)}
    if any(manifest.get(k) != v for k, v in wanted.items()):
        raise ValueError("the feed has no valid completed generation")
    return manifest


# -- generations of a feed, in a folder that only its owner may read


@contextmanager
def _publishing(base: str):
    info = os.lstat(base)
    if not stat.S_ISDIR(info.st_mode) or info.st_mode & 0o077:
        raise PermissionError("a feed lies in a folder of mode 0700")
    with open(os.path.join(base, ".publish.lock"), "a", encoding="utf-8") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        yield Path(base)


def publish(base: str, generation: str) -> str:
    """Make a verified folder under ``incoming`` the current generation, in one step."""
    if not GENERATION.fullmatch(generation):
        raise ValueError("invalid name of a generation")
    with _publishing(base) as root:
        target = root / "generations" / generation
        if target.exists() or target.is_symlink():
            raise FileExistsError(target)
        target.parent.mkdir(mode=0o700, exist_ok=True)
        (root / "incoming" / generation).rename(target)
        pointer = root / f".current-{generation}"
        pointer.symlink_to(Path("generations") / generation)
        pointer.replace(root / "current")
        return str(target)


def prune(base: str, keep: int) -> int:
    """Delete all generations but the newest by name and the current one; how many went."""
    if keep < 2:
        raise ValueError("at least two generations are kept")
    with _publishing(base) as root:
        current = (root / "current").resolve(strict=True)
        names = sorted((g for g in (root / "generations").iterdir() if g.is_dir() and not g.is_symlink()), reverse=True)
        gone = [g for g in names[keep:] if g.resolve() != current]
        for g in gone:
            shutil.rmtree(g)
        return len(gone)


def backups_to_delete(names: Sequence[str], patterns: Sequence[str], keep: int = 4) -> list[str]:
    """Backups beyond the newest of each name pattern."""
    out: set[str] = set()
    for pattern in patterns:
        out.update(sorted((n for n in names if re.fullmatch(pattern, n)), reverse=True)[keep:])
    return sorted(out)
