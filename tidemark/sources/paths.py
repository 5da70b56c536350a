"""Where a project keeps its tables and results, below one root that Spark can reach."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Raw tables, and predictors of truncated histories with and without static columns.
RAW = {"operational": "train_operational_readouts.csv", "specifications": "train_specifications.csv", "tte": "train_tte.csv"}
SPLITS = ("train", "val", "test")
VARIANTS = {"without_static": "without_static", "with_static": "with_static"}


@dataclass(frozen=True)
class Paths:
    """Folders and files by name; nothing is made before :meth:`create`."""

    root: str

    def _at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    @property
    def folders(self) -> dict[str, str]:
        return {
            "raw": self._at("data", "raw"),
            "processed": self._at("data", "processed"),
            "sequences": self._at("data", "processed", "sequences"),
            "truncated": self._at("data", "processed", "tabular_truncated"),
            "results": self._at("results"),
            "figures": self._at("results", "figures"),
            "tables": self._at("results", "tables"),
            "logs": self._at("results", "logs"),
        }

    def raw(self, name: str) -> str:
        return f"{self.folders['raw']}/{RAW[name]}"

    def predictors(self, split: str, variant: str) -> str:
        return f"{self.folders['truncated']}/X_{self._split(split)}_trunc_{VARIANTS[variant]}.csv"

    def targets(self, split: str) -> str:
        return f"{self.folders['truncated']}/y_{self._split(split)}_trunc.csv"

    def sequences(self, split: str, truncated: bool = False) -> str:
        return f"{self.folders['sequences']}/{self._split(split)}_seq_{'truncated' if truncated else 'full'}"

    @staticmethod
    def _split(split: str) -> str:
        if split not in SPLITS:
            raise ValueError(f"split must be one of {', '.join(SPLITS)}")
        return split

    def create(self, spark: SparkSession) -> None:
        """Makes the folders that aren't there."""
        for folder in self.folders.values():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
