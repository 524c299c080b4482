"""Materialised intermediates: where they go and how they are deleted."""

import os

from pedalgrid import session


def test_settled_tables_can_be_discarded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}")
    assert session.settle(spark.range(5)).count() == 5
    folder = tmp_path / "pedalgrid" / spark.sparkContext.applicationId
    assert len(os.listdir(folder)) == 1
    session.discard(spark)
    assert not folder.exists()


def test_a_local_session_without_a_folder_makes_one(spark, monkeypatch):
    monkeypatch.setattr(session, "CHECKPOINT_KEY", "spark.no.such.key")
    made = session.shared_folder(spark)
    assert os.path.isdir(made) and session.shared_folder(spark) == made
