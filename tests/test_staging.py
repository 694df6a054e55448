from pathlib import Path

import pytest

from themeloom import staging
from themeloom.plans import corpus


class Context:
    def __init__(self, master, shared=None):
        self.applicationId, self.master, self.shared = "app-1", master, shared

    def getConf(self):
        return {}


class Session:
    """The parts of a session that name the staging folder."""

    def __init__(self, master, shared=None):
        self.sparkContext, self.shared = Context(master), shared
        self.conf = self

    def get(self, name, default=None):
        return self.shared if name == "spark.checkpoint.dir" else default


def test_the_clusters_folder_is_used():
    assert staging.staging_root(Session("yarn", "hdfs:///ck/")) == "hdfs:///ck/themeloom/app-1"


def test_a_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.staging_root(Session("yarn"))


def test_a_local_folder_is_made_once():
    root = staging.staging_root(Session("local[2]"))
    assert Path(root).is_dir() and staging.staging_root(Session("local[2]")) == root


def test_stage_and_drop(spark):
    rows = staging.stage(spark.range(5), "five")
    assert rows.count() == 5 and len(rows.inputFiles()) > 0
    root = Path(staging.staging_root(spark))
    assert any(root.iterdir())
    staging.drop_staged(spark)
    assert not root.exists()


def staged_names(spark):
    root = Path(staging.staging_root(spark))
    return sorted(path.name.rsplit("-", 1)[0] for path in root.iterdir()) if root.exists() else []


def test_what_is_staged_on_the_way_goes(spark):
    staging.drop_staged(spark)

    def second():
        return staging.stage_only(lambda: staging.stage(spark.range(7), "a").where("id > 1"), "b").where("id > 2")

    kept = staging.stage(spark.range(3), "other")
    found = staging.stage_only(lambda: second().where("id > 3"), "c")
    assert staged_names(spark) == ["c", "other"]
    assert sorted(row.id for row in found.collect()) == [4, 5, 6] and kept.count() == 3
    with pytest.raises(ZeroDivisionError):
        staging.stage_only(lambda: 1 // 0, "never")
    assert staging.stage(spark.range(2), "d").count() == 2 and staged_names(spark) == ["c", "d", "other"]
    staging.drop_staged(spark)


def test_a_corpus_run_leaves_one_table(spark):
    """Texts and tokens of every step side by side took many times the room of the input."""
    texts = spark.createDataFrame([(i, "taxes paid river boats audit credit union wages " * 20) for i in range(60)], "doc_id long, text string")
    for run, name in ((corpus.prepared_documents, "documents"), (corpus.prepared_chunks, "chunks")):
        staging.drop_staged(spark)
        settings = corpus.CorpusSettings(min_tokens=0)
        rows = run(texts, settings)
        assert staged_names(spark) == [name]
        assert rows.count() >= 60
    staging.drop_staged(spark)


def test_a_longer_stop_list_of_chunks_holds_after_phrases(spark):
    texts = spark.createDataFrame([(i, "taxes paid river boats audit credit union wages " * 20) for i in range(60)], "doc_id long, text string")
    settings = corpus.CorpusSettings(min_tokens=0, filter_after_phrases=True)
    seen, longer = [], corpus.longer_phrase_tokens
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus, "longer_phrase_tokens", lambda docs, used, key: seen.append(used) or longer(docs, used, key))
        corpus.prepared_chunks(texts, settings, top=3)
    assert len(seen[0].stop_words) == len(settings.stop_words) + 3
