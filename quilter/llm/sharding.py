"""Sharding by a permutation-filled lookup table. Built-in functions only.

Each shard orders the slots of a table of prime size by its own permutation
``(offset + j * skip) mod size``. In turns, every shard claims the first slot of its
order that is still free, until none is. A row's slot is the hash of its key modulo
the size, and its shard is the slot's owner: one broadcast hash join against the
table, whose row count is the prime and never depends on the data. Shards differ by
at most one slot; when a shard leaves, few slots of the others move.

Hashes are the first 60 bits of md5, so that any engine can repeat them. Rows are
placed where they stand: no shuffle, and a frequent key costs nothing more.

Defined results: a null key is placed as the empty string; equal keys get equal
slots and shards; an empty input gives an empty result; rows may repeat; there are no ties; texts of any length are hashed whole;
other columns are ignored, and slot and shard get an underscore where the key column has their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quilter.llm.common import free

#: Production parameters: a prime over 100 times the number of shards.
TABLE_SIZE = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(256))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """Owner (index into shards) of every slot."""
    if not is_prime(size) or not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("the size must be a prime not under the number of shards, which must be distinct")
    slot = [_number(f"{s}/offset") % size for s in shards]
    skip = [_number(f"{s}/skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner, free = [-1] * size, size
    while True:
        for i in range(len(shards)):
            at = slot[i]
            while owner[at] >= 0:
                at = (at + skip[i]) % size
            owner[at], slot[i] = i, (at + skip[i]) % size
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, size: int) -> Column:
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return (F.conv(digest, 16, 10).cast("long") % size).cast("int")


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """(slot, shard) of every slot, from two literals."""
    owners = ",".join(map(str, fill_table(shards, size)))
    names = F.split(F.lit("\n".join(shards)), "\n")
    table = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return table.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def place(df: DataFrame, key_col: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """key_col, slot and shard of every row."""
    rows = df.select(F.struct(F.col(key_col).alias("key_")).alias("own_"), slot_of(F.col(key_col), size).alias("slot"))
    owners = lookup_table(df.sparkSession, shards, size)
    out = rows.join(F.broadcast(owners), "slot")
    return out.select(F.col("own_.key_").alias(key_col), *(F.col(c).alias(free(c, (key_col,))) for c in ("slot", "shard")))


def oracle(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> str:
    """DuckDB SQL for ``place`` over documents; the filled table is a literal in it, as filling takes a loop."""
    owners = ",".join(map(str, fill_table(shards, size)))
    return f"""
        WITH t AS (SELECT string_split('{owners}', ',') AS owners),
        d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS INTEGER) AS slot FROM documents)
        SELECT doc_id, slot, 'shard-' || lpad(owners[slot + 1], 3, '0') AS shard FROM d, t"""
