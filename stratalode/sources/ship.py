"""Makes this package importable in Python workers of a session that was started without it."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .shared import shared_folder

_shipped: set[str] = set()


def archive() -> bytes:
    """The package's sources and models as a zip file."""
    root, out = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".json"):
                z.write(p, p.relative_to(root.parent))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Puts the package into the shared folder and on the path of Python workers, once per application.

    On a cluster without ``spark.checkpoint.dir`` there is no such folder; the package
    must then be installed on the workers.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if not sc.master.startswith("local") and not spark.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        return
    root = Path(__file__).resolve().parents[1].name
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{sc.applicationId}/{root}.zip")
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(archive()))
    out.close()
    sc.addPyFile(at.toString())
