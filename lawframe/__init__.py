"""A PySpark-native analytics engine for document corpora."""

from __future__ import annotations


def ship(spark) -> None:
    """Send this package to the session's executors, where it isn't installed there: a zip by Spark's file server."""
    import tempfile
    import zipfile
    from pathlib import Path

    here = Path(__file__).resolve().parent
    held = Path(tempfile.mkdtemp(prefix="ship-")) / "lawframe.zip"  # read by the driver alone, which hands it out
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(here.rglob("*.py")):
            archive.write(path, path.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(held))
