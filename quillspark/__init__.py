"""A Spark-native analytics engine for digitised text libraries."""

from __future__ import annotations


def ship(spark) -> None:
    """Give the cluster's Python workers this package, once a Spark context."""
    import pathlib
    import tempfile
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    here = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp()) / "quillspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(str(archive))
    context._quillspark_shipped = True
