"""Pseudonym mapping: original hash → fake value per session, with encrypted originals.

MAPPING has one row per ``(session_id, original_hash)``:
``record_id, session_id, entity_type, original_hash, real_value_encrypted, fake_value,
created_utc, document_hash, occurrences``.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import checksums as C
from veilframe.functions import fakes
from veilframe.functions.arrays import let, lit
from veilframe.operators.guard import assert_no_private_columns
from veilframe.session import hide_keys, join_hot_split, materialise, packed, small_enough, union_parts

KDF_ITERATIONS = 600_000
KEY_BYTES = 32
REHASH_ROUNDS = 2


class MappingError(ValueError):
    """A mapping could not be read, for example because the key is wrong."""


def derive_key(passphrase: str, salt: bytes, iterations: int = KDF_ITERATIONS) -> bytes:
    """PBKDF2-HMAC-SHA256 key; run once on the driver, never per row."""
    if not passphrase:
        raise ValueError("a passphrase is required")
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode("utf-8"), salt, iterations, KEY_BYTES)


def originals(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Distinct originals; the entity of the earliest occurrence decides the kind of fake.

    Plain aggregates only, so repeated values are merged before the shuffle.
    """
    place = F.struct(F.col(doc), F.col("chunk_ord"), (-F.col("start")).alias("back"))
    return (spans.withColumn("original_hash", F.expr(C.hex_hash("original")))
            .groupBy("original_hash")
            .agg(F.min_by("entity_type", place).alias("entity_type"),
                 F.min("original").alias("original"),
                 F.min_by(F.col(doc).cast("string"), place).alias("first_doc"),
                 F.count(F.lit(1)).alias("occurrences")))


def _with_fake(rows: DataFrame, salt: str, attempt: str) -> DataFrame:
    """Fake of each row; a number that began with "+" gets one that does too."""
    made = fakes.fake_value("entity_type", fakes.seeded(lit(salt), "original_hash", attempt))
    return (rows.withColumn("_made", F.expr(made))
            .withColumn("_made", F.expr("IF(plus AND entity_type = 'UK_PHONE', "
                                        "regexp_replace(_made, '^0', '+44 '), _made)")))


def usual_fake(entity: str, value_hash: str, plus: str, salt: str) -> str:
    """SQL expression of the fake that ``assign_fakes`` tries first for a value."""
    made = let(fakes.seeded(lit(salt), value_hash), lambda h: fakes.fake_value(entity, h))
    return let(made, lambda m: f"IF({plus} AND {entity} = 'UK_PHONE', regexp_replace({m}, '^0', '+44 '), {m})")


def assign_fakes(firsts: DataFrame, salt: str, taken: DataFrame | None = None) -> DataFrame:
    """Add ``fake_value``, unique among ``firsts``, ``taken`` fakes and the real values.

    The first owner of a fake is the row with the lowest hash. Other rows get a new hash
    REHASH_ROUNDS times, then part of their own hash as a suffix, then all of it. A fake that was kept
    once is never lost later, so each round looks at the fakes it made alone, without the other columns.
    """
    rows = packed(_with_fake(firsts, salt, "0").withColumnRenamed("_made", "fake_value")
                  .withColumn("_id", F.monotonically_increasing_id()))
    real = rows.select(F.unhex("original_hash").alias("_real"))
    before, made, changed = [], rows, []
    for attempt in range(1, REHASH_ROUNDS + 3):
        made = made.select("_id", "original_hash", "entity_type", "plus", "fake_value")
        losers = materialise(_losers(made, real, before, taken))
        if losers.isEmpty():
            break
        before.append(made.select("fake_value"))
        if attempt <= REHASH_ROUNDS:
            made = _with_fake(losers, salt, str(attempt)).drop("fake_value").withColumnRenamed("_made", "fake_value")
        else:
            own = "left(original_hash, 12)" if attempt == REHASH_ROUNDS + 1 else "original_hash"
            made = losers.withColumn("fake_value", F.expr(f"concat(fake_value, '-', {own})"))
        made = materialise(made)
        changed.append(made.select("_id", F.lit(attempt).alias("_attempt"), F.col("fake_value").alias("_new")))
    if changed:
        last = reduce(DataFrame.unionByName, changed).groupBy("_id").agg(F.max_by("_new", "_attempt").alias("_new"))
        last = F.broadcast(last) if small_enough(changed[0]) else last.hint("merge")
        rows = packed(rows.join(last, "_id", "left").withColumn("fake_value", F.coalesce("_new", "fake_value"))
                      .select(*rows.columns))
    return rows.drop("_id")


def _among(made: DataFrame, key: Column, others: DataFrame, small: bool) -> DataFrame:
    """``_id`` of the rows whose ``key`` is in the one column of ``others``."""
    name = others.columns[0]
    keys = made.select("_id", key.alias(name))
    if small:
        met = others.join(F.broadcast(keys.select(name)), name, "left_semi").distinct()
        return keys.join(F.broadcast(met), name, "left_semi").select("_id")
    return keys.join(others.hint("merge"), name, "left_semi").select("_id")


def _losers(made: DataFrame, real: DataFrame, before: list[DataFrame], taken: DataFrame | None) -> DataFrame:
    """Rows of ``made`` whose fake belongs to another row, now or ``before``, or is one of the real values."""
    small = small_enough(made)
    fake = F.col("fake_value")
    lost = _among(made, F.unhex(F.expr(C.hex_hash("fake_value"))), real, small)
    for others in [*before, *([] if taken is None else [taken.select("fake_value")])]:
        lost = union_parts(lost, _among(made, fake, others, small))
    owners = materialise(made.groupBy("fake_value").agg(F.unhex(F.min("original_hash")).alias("owner"),
                                                        F.count(F.lit(1)).alias("n")).filter("n > 1"))
    if not owners.isEmpty():
        clash = join_hot_split(made.select("_id", F.unhex("original_hash").alias("_own"), "fake_value"), owners,
                               "fake_value", "n")
        lost = union_parts(lost, clash.filter("_own != owner").select("_id"))
    lost = materialise(lost.distinct())
    return made.join(F.broadcast(lost) if small_enough(lost) else lost.hint("merge"), "_id", "left_semi")


def encrypt(value: str, key: bytes) -> str:
    """AES-256-GCM: random 12-byte nonce, ciphertext and 16-byte tag in one binary."""
    return f"aes_encrypt({value}, X'{key.hex()}', 'GCM')"


def decrypt(blob: str, key: bytes) -> str:
    """Text, or NULL when the key does not fit."""
    return f"cast(try_aes_decrypt({blob}, X'{key.hex()}', 'GCM') AS string)"


def build_mapping(spans: DataFrame, session_id: str, key: bytes, *, salt: str = "",
                  existing: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """Rows to append for one session: originals that ``existing`` does not hold yet.

    Values are encrypted before anything is written to the checkpoint folder, and written
    once, because nonces are random.
    """
    hide_keys(spans.sparkSession)
    firsts = originals(spans, doc)
    taken = None
    if existing is not None:
        taken = existing.filter(F.col("session_id") == session_id)
        firsts = firsts.join(taken.select("original_hash"), "original_hash", "left_anti")
    record = F.sha2(F.concat_ws("|", F.lit(session_id), "original_hash"), 256)
    sealed = firsts.select(
        record.alias("record_id"), F.current_timestamp().alias("created_utc"),
        F.lit(session_id).alias("session_id"), "entity_type", "original_hash",
        F.expr(encrypt("original", key)).alias("real_value_encrypted"),
        F.expr(C.hex_hash("first_doc")).alias("document_hash"), "occurrences",
        F.expr("original LIKE '+%'").alias("plus"))
    return assign_fakes(sealed, session_id + salt, taken).drop("plus")


def insert_if_absent(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Existing rows plus the new ones whose key is not there: the first write wins."""
    keys = ["session_id", "original_hash"]
    fresh = rows.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def lookup(hashes: DataFrame, mapping: DataFrame, session_id: str) -> DataFrame:
    """Fake of each ``original_hash``, NULL where the session has none."""
    session = (mapping.filter(F.col("session_id") == session_id)
               .select("original_hash", "fake_value"))
    return hashes.join(session, "original_hash", "left")


def replacements(mapping: DataFrame, session_id: str, key: bytes, *more: str) -> DataFrame:
    """``fake_value → real_value`` of a session, and ``more`` columns. A wrong key fails the job that reads it."""
    hide_keys(mapping.sparkSession)
    plain = decrypt("real_value_encrypted", key)
    problem = lit("mapping cannot be decrypted with this key")
    return (mapping.filter(F.col("session_id") == session_id)
            .withColumn("real_value", F.expr(plain))
            .select("fake_value", F.expr(
                f"coalesce(real_value, raise_error({problem}))").alias("real_value"), *more))


def check_key(mapping: DataFrame, session_id: str, key: bytes) -> None:
    """Raise MappingError when one row of the session cannot be decrypted."""
    hide_keys(mapping.sparkSession)
    row = (mapping.filter(F.col("session_id") == session_id)
           .select(F.expr(decrypt("real_value_encrypted", key)).alias("v")).first())
    if row is not None and row["v"] is None:
        raise MappingError("mapping cannot be decrypted with this key")


def sessions(mapping: DataFrame) -> DataFrame:
    return mapping.select("session_id").distinct()


def purge(mapping: DataFrame, session_id: str) -> DataFrame:
    """The mapping without one session."""
    return mapping.filter(F.col("session_id") != session_id)


def purge_to(mapping: DataFrame, session_id: str, path: str) -> int:
    """Store the mapping without one session in a new folder; returns how many rows it had."""
    write_mapping(purge(mapping, session_id), path)
    return mapping.filter(F.col("session_id") == session_id).count()


def write_mapping(mapping: DataFrame, path: str) -> None:
    """Append to a parquet table partitioned by session."""
    assert_no_private_columns(mapping).write.mode("append").partitionBy("session_id").parquet(path)
