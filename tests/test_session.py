"""Where written tables go."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from ledgerlens.jobs import JOBS
from ledgerlens.session import CHECKPOINT_SETTING, drop_path, new_table_path, shared_folder, temporary_tables, write_result, write_table
from ledgerlens.sources.order_star import derive
from ledgerlens.sources.star import Star


def session(setting=None, context_folder=None, application="app-1", master="local[2]"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: setting if name == CHECKPOINT_SETTING else default),
        sparkContext=SimpleNamespace(
            getCheckpointDir=lambda: context_folder, applicationId=application, master=master
        ),
    )


def test_the_folder_the_session_names_comes_first():
    assert shared_folder(session("hdfs:///shared/", "hdfs:///other")) == "hdfs:///shared"
    assert shared_folder(session(None, "hdfs:///other")) == "hdfs:///other"


def test_an_own_folder_is_made_once_per_application():
    first = shared_folder(session())
    assert shared_folder(session()) == first
    assert shared_folder(session(application="app-2")) != first


def test_this_session_names_a_folder(spark):
    assert shared_folder(spark)



@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(application="app-3", master=master))


def folders(spark) -> set[str]:
    root = Path(shared_folder(spark).removeprefix("file:")) / "ledgerlens" / spark.sparkContext.applicationId
    return {entry.name for entry in root.iterdir()} if root.exists() else set()


def test_tables_go_with_their_scope(spark):
    before = folders(spark)
    with temporary_tables(spark):
        one = write_table(spark.range(3), "one")
        with temporary_tables(spark):
            write_table(spark.range(2), "two")
            assert len(folders(spark) - before) == 2
        assert len(folders(spark) - before) == 1 and one.count() == 3
        three = write_result(spark, lambda: write_table(spark.range(5), "four").filter("id > 1"), "three")
        assert len(folders(spark) - before) == 2 and three.count() == 3
    assert folders(spark) == before


def test_tables_go_after_a_failure_and_when_already_gone(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), temporary_tables(spark) as tables:
        write_table(spark.range(3), "one")
        drop_path(spark, tables.paths[0])
        new_table_path(spark, "never-written")
        raise ZeroDivisionError
    assert folders(spark) == before


def test_no_job_leaves_a_table(spark, small_folder, tmp_path):
    """Whatever jobs write on their way is dropped with their results written; the star's own tables with the star."""
    before = folders(spark)
    with Star(spark, lambda name: write_table(derive(spark, small_folder, name), name)) as star:
        for name in star_tables():
            star.table(name)
        for number, (name, job) in enumerate(JOBS.items()):
            with temporary_tables(spark):
                job(star).write.parquet(f"{tmp_path}/{number}")
        kept = {name.rsplit("-", 1)[0] for name in folders(spark) - before}
        assert kept == {*star_tables(), "customer-signals"}
    assert folders(spark) == before


def star_tables() -> list[str]:
    return ["fact_transactions", "dim_customer", "dim_account", "dim_merchant", "dim_location", "dim_date"]
