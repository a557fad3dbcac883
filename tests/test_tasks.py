"""Functions sent to executors work there without this package; the archive is packed without any."""

import pathlib
import subprocess
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from tlake.plans.inventory import _footers
from tlake.streaming.archive import packed, write_otlp_archive
from workload import fixtures as fx

CODE = """
import sys, pickle, pandas as pd
f, arg = pickle.load(open(sys.argv[1], "rb"))
assert not any(m.startswith("tlake") for m in sys.modules)
out = pd.concat(list(f(iter([pd.DataFrame(arg)]))))
print(len(out))
"""


def test_self_contained(spark, tmp_path):
    spark.range(10).selectExpr("id as Timestamp_ns").coalesce(1).write.parquet(f"{tmp_path}/p")
    path = next((tmp_path / "p").glob("*.parquet"))
    f = _footers("Timestamp_ns", ["path", "n", "rows", "c", "u", "min_ns", "max_ns"])
    (tmp_path / "f").write_bytes(cloudpickle.dumps((f, {"path": [f"file:{path}"], "length": [1]})))
    run = subprocess.run([sys.executable, "-c", CODE, str(tmp_path / "f")], cwd=tmp_path, capture_output=True, text=True)
    assert run.stdout.strip() == "1", run.stderr


def test_packing_stays_in_the_jvm(spark, sf_dir, tmp_path, capsys):
    """No Python in the plan, at most the wanted records in a request, files named ``.json``."""
    logs = fx.logs(spark, sf_dir)
    requests = packed(logs, 50)
    requests.explain()
    shown = capsys.readouterr().out
    assert "Aggregate" in shown and not any(w in shown for w in ("Python", "Pandas", "Arrow"))
    sizes = [r[0] for r in requests.select(F.size(F.col("resourceLogs")[0]["scopeLogs"][0]["logRecords"])).collect()]
    assert sum(sizes) == logs.count() and max(sizes) <= 50
    path = write_otlp_archive(logs, str(tmp_path), "otel")
    assert all(f.suffix == ".json" for f in pathlib.Path(path).glob("part-*"))
