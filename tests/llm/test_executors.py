import subprocess
import sys
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from themeloom.session import local_session
import __spark_entry__
spark = local_session(4, "elsewhere", "4g")
queries = __spark_entry__.queries()
for name in {names!r}:
    queries[name](spark, {folder!r}).write.format("noop").mode("overwrite").save()
print("fine")
"""
NAMES = [
    ["op1_source_mixing", "op2_minhash_near_duplicates", "op4_surrogate_entities", "op5_robust_outliers"],
    ["op6_attention_scores", "op7_counterfactual_toxicity", "op8_exact_top_scores", "op9_best_fit_packing"],
    ["op10_main_text", "op11_token_alignment", "op12_shared_lines", "op13_merkle_manifest", "op3_stratified_shards"],
    ["pipeline"],
]


@pytest.mark.parametrize("names", NAMES, ids=lambda names: names[0])
def test_tasks_need_no_copy_of_the_package(tmp_path, names):
    """A driver that found the package by path, with workers that cannot."""
    repo = str(Path(__file__).resolve().parents[2])
    script = SCRIPT.format(repo=repo, names=names, folder=FOLDER)
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert run.stdout.strip().endswith("fine"), run.stderr[-2000:]
