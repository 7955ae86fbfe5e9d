"""Rows that pages are built from are dealt over the tasks before they grow."""

import pytest
from conftest import SF_DIR

from pagedrift.functions.text import NORMALIZE, NORMALIZE_GATES, normalize_text, replace_in_order, trim_blanks
from pagedrift.plans.jobs import _documents, _pages
from pagedrift.sources.derived import SPREAD, derived


@pytest.mark.parametrize("name", sorted(SPREAD))
def test_pages_of_one_file_are_the_work_of_all_tasks(spark, name):
    assert derived(spark, SF_DIR, name).rdd.getNumPartitions() == 8


def test_long_texts_of_one_row_group_are_the_work_of_all_tasks(spark):
    """Before, a file of one row group was one task (F21)."""
    assert _documents(spark, SF_DIR, "text").rdd.getNumPartitions() == 8
    assert _pages(spark, SF_DIR).rdd.getNumPartitions() == 8


def test_one_look_leaves_out_only_what_finds_nothing(spark):
    texts = _documents(spark, SF_DIR, "text").select("text").unionByName(derived(spark, SF_DIR, "noted_texts").select("text"))
    steps = trim_blanks(replace_in_order(texts["text"], NORMALIZE, NORMALIZE_GATES))
    assert texts.where(normalize_text(texts["text"]) != steps).isEmpty()
    one_by_one = trim_blanks(replace_in_order(texts["text"], NORMALIZE))
    assert texts.where(normalize_text(texts["text"]) != one_by_one).isEmpty()
