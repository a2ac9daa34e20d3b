"""Artifacts in write-once generations, with content hashes and an index; memoised tables."""

from __future__ import annotations

import hashlib
import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import Refused


def hash_params(params: dict, length: int = 16) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:length]


def hash_table(df: DataFrame) -> str:
    """A digest of the rows of a table in any order: count, sum and xor of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).head()
    return hash_params({"n": r.n, "s": str(r.s), "x": r.x, "columns": sorted(df.columns)})


class ArtifactStore:
    """Tables and JSON of a run below ``root/genNN``; an older generation is never touched, a read falls back to it."""

    def __init__(self, root: str) -> None:
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)
        if not self.generations():
            self.new_generation("first")

    def generations(self) -> list[Path]:
        return sorted(p for p in self.root.glob("gen[0-9][0-9]*") if p.is_dir())

    @property
    def current(self) -> Path:
        return self.generations()[-1]

    def new_generation(self, note: str = "") -> Path:
        n = len(self.generations()) + 1
        p = self.root / f"gen{n:02d}"
        p.mkdir()
        self._index({"kind": "generation", "name": p.name, "note": note})
        return p

    def _index(self, row: dict) -> None:
        with (self.root / "index.jsonl").open("a") as f:
            f.write(json.dumps(row, ensure_ascii=False) + "\n")

    def index(self) -> list[dict]:
        p = self.root / "index.jsonl"
        return [json.loads(x) for x in p.read_text().splitlines()] if p.exists() else []

    def put_table(self, name: str, df: DataFrame, fmt: str = "parquet") -> Path:
        if fmt not in ("parquet", "csv", "orc", "json"):
            raise Refused(f"no sink for {fmt!r}")
        p = self.current / f"{name}.{fmt}"
        if p.exists():
            raise Refused(f"{p.name} exists in {self.current.name}; open a new generation")
        w = df.write.mode("errorifexists")
        (w.option("header", True).csv if fmt == "csv" else getattr(w, fmt))(str(p))
        back = getattr(df.sparkSession.read.option("header", True), fmt)(str(p))
        self._index({"kind": "table", "name": name, "generation": self.current.name, "format": fmt, "rows": back.count(), "columns": df.columns, "hash": hash_table(df)})
        return p

    def put_json(self, name: str, value: object) -> Path:
        p = self.current / f"{name}.json"
        if p.exists():
            raise Refused(f"{p.name} exists in {self.current.name}; open a new generation")
        p.write_text(json.dumps(value, ensure_ascii=False, indent=1, default=str))
        self._index({"kind": "json", "name": name, "generation": self.current.name})
        return p

    def find(self, file: str) -> Path:
        """The newest generation's copy of a file."""
        for g in reversed(self.generations()):
            if (g / file).exists():
                return g / file
        raise FileNotFoundError(file)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(str(self.find(f"{name}.parquet")))

    def json(self, name: str) -> object:
        return json.loads(self.find(f"{name}.json").read_text())

    def memoize(self, spark: SparkSession, op: str, params: dict, input_hash: str, compute) -> DataFrame:
        """A table computed once for its operation, parameters and input; a damaged copy is removed and computed again."""
        p = self.root / "memo" / f"{op}-{hash_params(params | {'_input': input_hash})}.parquet"
        if p.exists():
            if (p / "_SUCCESS").exists():
                return spark.read.parquet(str(p))
            shutil.rmtree(p)
        compute().write.parquet(str(p))
        return spark.read.parquet(str(p))
