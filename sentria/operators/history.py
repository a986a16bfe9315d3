"""An append-only store of analyses: users, sessions and results as tables.

Rows are appended; a deletion is an anti join with the deleted keys, and a name is unique if it isn't
among the stored ones. Passwords are hashed on the driver, never in a plan.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.functions import text as T

ITERATIONS = 200_000
NAME = re.compile(r"[a-zA-Z0-9_.-]{3,32}")
LEAST_PASSWORD = 6
MOST_TEXT = 20_000


class NameTaken(Exception):
    pass


class BadCredentials(Exception):
    pass


def hash_password(password: str, salt: str) -> str:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt.encode(), ITERATIONS).hex()


class Store:
    """Tables users, sessions, ended and analyses below a folder that all executors share."""

    SCHEMAS = {
        "users": "id long, name string, hash string, salt string, created_at timestamp",
        "sessions": "token string, user_id long, created_at timestamp",
        "ended": "token string",
        "analyses": "id long, user_id long, essay_text string, result_json string, n_sentences int, n_flagged int, mean_prob double, created_at timestamp",
    }

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def table(self, name: str) -> DataFrame:
        empty = self.spark.createDataFrame([], self.SCHEMAS[name])
        path = f"{self.base}/{name}"
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(path) if there else empty

    def _append(self, name: str, row: tuple) -> None:
        self.spark.createDataFrame([row], self.SCHEMAS[name].replace(", created_at timestamp", "")).withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.base}/{name}")

    def _next(self, name: str) -> int:
        return self.table(name).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1

    def sign_up(self, name: str, password: str) -> int:
        name = name.strip()
        if not NAME.fullmatch(name) or len(password) < LEAST_PASSWORD:
            raise ValueError("name or password")
        if self.table("users").where(F.col("name") == name).limit(1).count():
            raise NameTaken(name)
        salt, uid = secrets.token_hex(16), self._next("users")
        self._append("users", (uid, name, hash_password(password, salt), salt))
        return uid

    def log_in(self, name: str, password: str) -> str:
        row = self.table("users").where(F.col("name") == name.strip()).first()
        if row is None or not hmac.compare_digest(hash_password(password, row["salt"]), row["hash"]):
            raise BadCredentials
        token = secrets.token_urlsafe(32)
        self._append("sessions", (token, row["id"]))
        return token

    def user_of(self, token: str | None) -> int | None:
        if not token:
            return None
        row = self.table("sessions").where(F.col("token") == token).join(self.table("ended"), "token", "left_anti").first()
        return row["user_id"] if row else None

    def log_out(self, token: str) -> None:
        self.spark.createDataFrame([(token,)], self.SCHEMAS["ended"]).write.mode("append").parquet(f"{self.base}/ended")

    def save(self, user_id: int, text: str, result_json: str, n_sentences: int, n_flagged: int, mean_prob: float | None) -> int:
        new = self._next("analyses")
        self._append("analyses", (new, user_id, text, result_json, n_sentences, n_flagged, mean_prob))
        return new

    def listed(self, user_id: int, most: int = 50) -> DataFrame:
        rows = self.table("analyses").where(F.col("user_id") == user_id)
        return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(most).select("id", T.preview(F.col("essay_text")).alias("preview"), "n_sentences", "n_flagged", "mean_prob", "created_at")

    def one(self, analysis_id: int, user_id: int) -> DataFrame:
        return self.table("analyses").where((F.col("id") == analysis_id) & (F.col("user_id") == user_id))


def latest(rows: DataFrame, user: str, at: str, key: str, k: int = 50) -> DataFrame:
    """The latest k rows of each user; ties by key. Partitions keep k rows each before the shuffle."""
    own = W.partitionBy(user).orderBy(F.desc(at), key)
    return rows.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= k)


def valid_texts(rows: DataFrame, text: str, most: int = MOST_TEXT) -> tuple[DataFrame, DataFrame]:
    """Rows whose stripped text has 1 to ``most`` characters, and the others with why not."""
    n = F.coalesce(F.length(T.strip(F.col(text))), F.lit(0))
    bad = rows.withColumn("error", F.when(n == 0, F.lit("empty")).when(n > most, F.lit("too long"))).where("error is not null")
    return rows.where(n.between(1, most)), bad
