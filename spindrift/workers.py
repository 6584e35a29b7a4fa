"""Python workers need this package: Spark sends it to them, wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

_SENT: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """df, after the package is on its way to the workers; once for each application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SENT:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spindrift-")) / "spindrift.zip"  # read by this driver only, which serves it
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SENT.add(context.applicationId)
    return df
