"""Send this package to the executors, so that their Python workers can import it wherever they run."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's files, once for each Spark context."""
    context, home = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_lexis_shipped", False) or not home.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="lexis-")) / "lexis-sources.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(home.rglob("*.py")):
            z.write(source, source.relative_to(home.parent))
    context.addPyFile(str(archive))
    context._lexis_shipped = True
