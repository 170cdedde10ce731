"""The files that queries write first: their number grows with the tables, their size does not."""

import os

import pytest

from bomloom.plans import files as plans
from bomloom.plans.queries import QUERIES
from bomloom.sources import files

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "reader"), [("read_record_xml", "read_record_xml"), ("read_item_bills", "read_item_bills"), ("read_cypher", "read_cypher"), ("read_cyclonedx", "read_cyclonedx")])
def test_files_are_bounded(spark, monkeypatch, name, reader):
    whole, paths = getattr(files, reader), []
    monkeypatch.setattr(files, reader, lambda s, path: paths.append(path) or whole(s, path))
    expected = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(plans, "_PARENTS", 5)
    assert sorted(map(tuple, QUERIES[name](spark, SF).collect())) == expected
    at = paths[-1].removeprefix("file://")
    sizes = [os.path.getsize(f"{d}/{f}") for d, _, found in os.walk(at) for f in found if f.startswith("part-")]
    assert len(sizes) > 10 and max(sizes) < sum(sizes) / 4


def test_documents_share_files(spark, monkeypatch):
    """The number of files follows the parents by the hundred."""
    paths, whole = [], files.read_cyclonedx
    monkeypatch.setattr(files, "read_cyclonedx", lambda s, path: paths.append(path) or whole(s, path))
    parents = QUERIES["read_cyclonedx"](spark, SF).select("parent_id").distinct().count()
    found = [f for _, _, names in os.walk(paths[-1].removeprefix("file://")) for f in names if f.startswith("part-")]
    assert len(found) <= 4 < parents
