import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from themeloom.session import local_session
from themeloom.operators import cluster_metrics, coherence, lemmas
spark = local_session(2, "elsewhere", "2g")
docs = spark.createDataFrame([(1, ["cases", "cases"])], "doc_id long, tokens array<string>")
assert lemmas.lemmatised_by(docs, lemmas.table_worker).first().tokens == ["case", "case"]
assert coherence.word_windows(docs, ["cases"]).first().n == 1
points = spark.createDataFrame(
    [([0.0], 0), ([1.0], 0), ([9.0], 1), ([8.0], 1)], "vector array<double>, label int"
)
assert cluster_metrics.silhouette(points).first()[0] > 0.8
print("fine")
"""


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """A driver that found the package by path, with workers that cannot."""
    repo = str(Path(__file__).resolve().parents[1])
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert run.stdout.strip().endswith("fine"), run.stderr[-2000:]
