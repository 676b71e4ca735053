"""The public functions: one pair, whole catalogues, clusters of a directory, JSON lines from a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoichion.functions.columns import STRONG
from stoichion.operators.cluster import cluster_table, clusters
from stoichion.operators.search import mapping_pairs
from stoichion.plans.finder import find
from stoichion.sources import files
from stoichion.sources.files import ModelSpec


#: Addresses that a list may hold; the driver fetches them.
MOST_URLS = 1000


def _spec(model: str | ModelSpec) -> ModelSpec:
    return model if isinstance(model, ModelSpec) else ModelSpec(model)


def find_reference_in_target(spark: SparkSession, reference: str | ModelSpec, target: str | ModelSpec, identity: str = STRONG, subset: bool = True, budget: int | None = None) -> DataFrame:
    """(reference, target, species, reactions): all mappings of one model into another; text is Antimony."""
    rows = [files.one_network(spark, _spec(m).row(n)) for m, n in ((reference, "reference"), (target, "target"))]
    return mapping_pairs(*rows, identity=identity, subset=subset, budget=budget)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Networks in rows: of JSON lines where path ends in .txt or .jsonl, or of those at the addresses that such a file lists;
    else of the models in a directory.
    """
    if path.startswith(("http://", "https://")):
        return files.read_urls(spark, [path])
    if path.endswith(".txt"):
        urls = [r[0].strip() for r in spark.read.text(path).where(F.trim("value").rlike("^https?://")).limit(MOST_URLS + 1).collect()]
        if len(urls) > MOST_URLS:
            raise ValueError(f"more than {MOST_URLS} addresses")
        if urls:
            return files.read_urls(spark, urls)
    if path.endswith((".txt", ".jsonl")):
        return files.read_json_lines(spark, path)
    return files.networks(files.read_directory(spark, path))


def find_references_in_targets(spark: SparkSession, references: str, targets: str, identity: str = STRONG, budget: int | None = None) -> DataFrame:
    """A row for each pair of the models at two paths, misses too."""
    return find(load(spark, references), load(spark, targets), identity, budget)


def cluster_models(spark: SparkSession, path: str, identity: str = STRONG) -> DataFrame:
    """A row for each class of structurally identical models at a path."""
    return cluster_table(clusters(load(spark, path), identity))


def make_serialization_file(spark: SparkSession, directory: str, path: str) -> None:
    """JSON lines of a directory's models at path; what is there already stays."""
    files.serialize_directory(spark, directory, path)


def find_in_catalogue(spark: SparkSession, path: str, identity: str = STRONG, most_reactions: int = 15, names: list[str] | None = None, budget: int | None = None) -> DataFrame:
    """Search within one catalogue: models of up to so many reactions (or those named) as references, the larger ones as
    targets.
    """
    rows = load(spark, path)
    small = F.size("reactions") <= most_reactions
    references = rows.where(small) if names is None else rows.where(F.col("network").isin(names))
    return find(references, rows.where(~small), identity, budget)
