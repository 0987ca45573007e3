"""The photo query meets every form of metadata, on given rows and on every part."""

from graphloom.plans import parsed
from graphloom.session import table

SF = "/root/testdata/sf0.001"


def test_every_field_is_found_in_some_rows_and_no_part_is_left_out(spark):
    rows = parsed.photo_query(spark, SF).collect()
    assert len(rows) == len(parsed.PHOTOS) + table(spark, SF, "part").count() == len({r.id for r in rows})
    for name in rows[0].asDict():
        values = {r[name] for r in rows if r.id > 100}
        assert len(values) > 1, name
    assert any(r.rest is None for r in rows) and any(r.fields == "iso=800,camera_make=nikon" for r in rows)
