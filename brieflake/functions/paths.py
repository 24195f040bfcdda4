"""Where runs keep their data, as plain strings (any file system that Spark reads)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def term_dir(base: str, term: int) -> str:
    return f"{base}/term_{term:02d}"


def docket_dir(base: str, term: int, docket: str) -> str:
    return f"{term_dir(base, term)}/{docket}_pdfs"


def prediction_path(base: str, mode: str, docket: str) -> str:
    return f"{base}/predictions/{mode}/{docket}"


def manifest_path(base: str, term: int) -> str:
    return f"{term_dir(base, term)}/manifest"


def opinions_dir(base: str, term: int) -> str:
    return f"{base}/opinions/{term:02d}"


def index_dir(base: str) -> str:
    return f"{base}/indices"


def folder_of_name(name: Column) -> Column:
    """A voter's name as a folder name."""
    return F.translate(name, " ", "_")


def name_of_folder(folder: Column) -> Column:
    return F.translate(folder, "_", " ")


def result_path(base: str, experiment: str, docket: str, condition: str, model: str, replicate: int) -> str:
    safe = model.translate(str.maketrans("/: ", "___"))
    return f"{base}/{experiment}/{docket}_cond{condition}_{safe}_r{replicate}"
