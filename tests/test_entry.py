"""The entry module imports without reading files beside Spark and registers every key."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_without_spark_jars(tmp_path):
    code = (
        "import pyspark; pyspark.__file__ = %r\n"
        "import __spark_entry__ as e\n"
        "q, o = e.queries(), e.oracle_sql()\n"
        "assert len(q) >= 98 and set(o) <= set(q)\n" % str(tmp_path / "nowhere" / "__init__.py")
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
