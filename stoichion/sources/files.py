"""Models in files: JSON lines, and directories of Antimony and SBML; results in CSV."""

from __future__ import annotations

import os
import re
import tempfile
import urllib.request
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stoichion.model import NESTED
from stoichion.sources import antimony, sbml

#: Names of the fields of a network, and of a mapping, as JSON.
JSON = "s_id string, s_network_name string, s_reactant_lst array<array<double>>, s_product_lst array<array<double>>, s_reaction_names array<string>, s_species_names array<string>"
PAIR_JSON = "s_id string, s_species_assignment_lst array<int>, s_reaction_assignment_lst array<int>"
MATRIX_JSON = "s_id string, s_row_names array<string>, s_column_names array<string>, s_row_description string, s_column_description string, s_values array<array<double>>"
EXTENSIONS = (".xml", ".ant", ".txt", "")


def from_json(lines: DataFrame, value: str = "value", keep: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Networks in rows from JSON lines, with the columns keep of lines; blank lines and networks without species are left out;
    other classes too, or an error where strict.
    """
    x, keep = F.from_json(value, JSON), keep or []
    df = lines.where(F.length(F.trim(value)) > 0).select(*keep, x.alias("x"))
    own = F.contains(F.coalesce("x.s_id", F.lit("")), F.lit("Network")) & ~F.contains(F.coalesce("x.s_id", F.lit("")), F.lit("Collection"))
    if strict:
        own = own | F.raise_error(F.concat(F.lit("expected Network but got "), F.coalesce("x.s_id", F.lit("none")))).cast("boolean")
    df = df.where(own).where("size(x.s_species_names) > 0")
    cell = lambda s, j: F.struct(s.cast("int").alias("s"), j.cast("int").alias("j"), F.get(F.get("x.s_reactant_lst", s), j).alias("r"), F.get(F.get("x.s_product_lst", s), j).alias("p"))
    rows = F.transform("x.s_species_names", lambda _, s: F.transform("x.s_reaction_names", lambda _, j: cell(s, j)))
    cells = F.filter(F.flatten(rows), lambda c: (c["r"] != 0) | (c["p"] != 0))
    return df.select(*keep, F.col("x.s_network_name").alias("network"), F.col("x.s_species_names").alias("species"), F.col("x.s_reaction_names").alias("reactions"), cells.alias("cells"))


def read_json_lines(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    found = from_json(spark.read.text(path))
    return found if names is None else found.where(F.col("network").isin(names))


def matrices(side: str) -> Column:
    """Species by reactions, zeros filled in, of one side (r or p) of a network in a row."""
    # A species' own cells first, so that each value is looked for among those few, not among all of the network.
    own = F.transform("species", lambda _, s: F.filter("cells", lambda c: c["s"] == s))
    value = lambda row, j: F.aggregate(F.filter(row, lambda c: c["j"] == j), F.lit(0.0), lambda a, c: a + c[side])
    return F.transform(own, lambda row: F.transform("reactions", lambda _, j: value(row, j)))


def to_json(networks: DataFrame) -> DataFrame:
    """(value): a JSON line for each network."""
    x = F.struct(F.lit("Network").alias("s_id"), F.col("network").alias("s_network_name"), matrices("r").alias("s_reactant_lst"), matrices("p").alias("s_product_lst"), F.col("reactions").alias("s_reaction_names"), F.col("species").alias("s_species_names"))
    return networks.select(F.to_json(x).alias("value"))


def write_json_lines(networks: DataFrame, path: str, mode: str = "append") -> None:
    to_json(networks).write.mode(mode).text(path)


def pairs_to_json(pairs: DataFrame) -> DataFrame:
    """(reference, target, value): each mapping as JSON."""
    x = F.struct(F.lit("AssignmentPair").alias("s_id"), F.col("species").alias("s_species_assignment_lst"), F.col("reactions").alias("s_reaction_assignment_lst"))
    return pairs.select("reference", "target", F.to_json(x).alias("value"))


def pairs_from_json(rows: DataFrame, value: str = "value") -> DataFrame:
    x = F.from_json(value, PAIR_JSON)
    return rows.withColumn("_x", x).where("_x.s_id = 'AssignmentPair'").select(*[c for c in rows.columns if c != value], F.col("_x.s_species_assignment_lst").alias("species"), F.col("_x.s_reaction_assignment_lst").alias("reactions"))


def matrix_cells(rows: DataFrame, value: str = "value") -> DataFrame:
    """(row, col, value) cells of matrices given as JSON."""
    x = rows.select(F.from_json(value, MATRIX_JSON).alias("x")).select("x.*")
    at = x.select("s_column_names", F.posexplode(F.arrays_zip(F.col("s_row_names").alias("row"), F.col("s_values").alias("values"))).alias("_n", "line"))
    return at.select(F.col("line.row").alias("row"), F.explode(F.arrays_zip(F.col("s_column_names").alias("col"), F.col("line.values").alias("value"))).alias("c")).select("row", "c.col", "c.value")


def _parse_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # Few at a time: a parsed model is many objects.
    for batch in (x[i : i + 256] for x in batches for i in range(0, len(x), 256)):
        rows = []
        for path, value in zip(batch["path"], batch["value"], strict=True):
            name = path.rsplit("/", 1)[-1].split(".")[0]
            try:
                own = sbml.parse(value, name) if path.endswith(".xml") or value.lstrip().startswith("<") else antimony.parse(value, name)
                rows.append((path, None, own["network"], own["species"], own["reactions"], own["cells"]))
            except Exception as error:  # noqa: BLE001 - a bad file is a row of its own, whatever is wrong with it
                rows.append((path, f"{type(error).__name__}: {error}", None, None, None, None))
        yield pd.DataFrame(rows, columns=["path", "error", "network", "species", "reactions", "cells"])


def read_directory(spark: SparkSession, path: str, skip: DataFrame | None = None) -> DataFrame:
    """(path, error, network, species, reactions, cells): every model file below path; a file that can't be read has an
    error and no network. skip: a table with a column network; files of those names aren't parsed.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    base = F.element_at(F.split("path", "/"), -1)
    extension = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    files = files.where(extension.isin(*EXTENSIONS)).withColumn("network", F.get(F.split(base, r"\."), F.lit(0)))
    if skip is not None:
        files = files.join(skip.select("network").distinct(), "network", "left_anti")
    return files.select("path", "value").mapInPandas(_parse_rows, f"path string, error string, {NESTED}")


def networks(found: DataFrame) -> DataFrame:
    """The networks of read_directory()."""
    return found.where("error IS NULL").select("network", "species", "reactions", "cells")


def serialize_directory(spark: SparkSession, directory: str, path: str) -> None:
    """Appends the models of a directory that the JSON lines at path don't have yet."""
    from stoichion.plans.finder import store_has_files

    done = read_json_lines(spark, path) if store_has_files(spark, path) else None
    write_json_lines(networks(read_directory(spark, directory, done)), path)


def one_network(spark: SparkSession, row: dict) -> DataFrame:
    return spark.createDataFrame([row], NESTED)


@dataclass
class ModelSpec:
    """One model, by text, file or address: kind is antstr, antfile, sbmlstr, sbmlfile or sbmlurl."""

    model: str
    kind: str = "antstr"

    def row(self, name: str | None = None) -> dict:
        if self.kind == "antstr":
            return antimony.parse(self.model, name)
        if self.kind == "sbmlstr":
            return sbml.parse(self.model, name)
        if self.kind in ("antfile", "sbmlfile"):
            with open(self.model, "rb") as file:
                data = file.read()
            name = name or self.model.rsplit("/", 1)[-1].split(".")[0]
            return antimony.parse(data.decode(), name) if self.kind == "antfile" else sbml.parse(data, name)
        if self.kind == "sbmlurl":
            return sbml.parse(fetch(self.model), name)
        raise ValueError(f"unknown kind of model {self.kind}")


def fetch(url: str) -> bytes:
    """What an address gives; anything but success is an error."""
    with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
        if answer.status != 200:
            raise ValueError(f"{url}: status {answer.status}")
        return answer.read()


def strings_from_url(url: str) -> list[str]:
    """The lines that an address gives."""
    return fetch(url).decode().split("\n")


def local_file_from_url(url: str, path: str | None = None) -> str:
    """Saves what an address gives on the driver, at path or in a new temporary file; where."""
    data = fetch(url)
    if path is None:
        handle, path = tempfile.mkstemp()
        os.close(handle)
    with open(path, "wb") as file:
        file.write(data)
    return path


def read_urls(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Networks of JSON lines at several addresses."""
    lines = [(line,) for url in urls for line in strings_from_url(url)]
    return from_json(spark.createDataFrame(lines, "value string"))


def antimony_of(model: str) -> str:
    """Antimony text of a model given as an address, a path to Antimony or SBML, SBML text, or Antimony text itself."""
    if re.match(r"^https?://", model):
        model = fetch(model).decode()
    elif "\n" not in model and os.path.exists(model):
        with open(model) as file:
            model = file.read()
    return antimony.render(sbml.parse(model)) if model.lstrip().startswith("<") else model


def serializer_path(parent: str, directory: str) -> str:
    """Where the JSON lines of a directory of models belong below a parent folder."""
    return f"{parent.rstrip('/')}/{directory.strip('/').rsplit('/', 1)[-1]}_serializers.txt"


def zip_member(path: str, part: str) -> str:
    """The text of the one member of a ZIP whose name holds part."""
    with zipfile.ZipFile(path) as archive:
        names = [n for n in archive.namelist() if part in n]
        if len(names) != 1:
            raise ValueError(f"{len(names)} members hold {part}")
        return archive.read(names[0]).decode()


def merge_csv(spark: SparkSession, directory: str, part: str) -> DataFrame:
    """Rows of all CSV files of a directory whose names hold part; columns that some lack are null there."""
    from stoichion.operators.report import merge
    from stoichion.plans.finder import list_files

    paths = [p for p in list_files(spark, directory) if p.endswith(".csv") and part in p.rsplit("/", 1)[-1]]
    return merge([spark.read.csv(p, header=True) for p in sorted(paths)])


def parse_result_path(path: str | Column) -> list[Column]:
    """identity, limit and directory from file names like strong10000_name.txt."""
    get = lambda i: F.regexp_extract(path, r"(strong|weak)(\d+)_([^/]*)\.txt$", i)
    return [get(1).alias("identity"), get(2).cast("long").alias("limit"), get(3).alias("directory")]


def write_csv(results: DataFrame, path: str) -> None:
    """Results with empty text for nulls."""
    results.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
