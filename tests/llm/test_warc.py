"""WARC archives and their audit."""

import hashlib


def test_merkle_audit(spark):
    from skarn.llm.warc import audit, read_archives, records, replicated, write_archives

    rows = [(i, f"http://x/{i}", f"<p>{i}\r\n\r\nß</p>", "n", "a") for i in range(300)] + [(None, "u", None, "n", "a"), (5, None, "again", "n", "a"), (5, None, "again", "n", "a"), (9, "", "z" * 300_000, "n", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, name string, archive string").repartition(3)
    original = write_archives(records(pages, archive_ids=128))
    assert audit(original, original).count() == 0
    lost = {130, 299}
    hurt = replicated(original, lambda page, data: None if page in lost else b"zz" if page == 77 else data)
    found = {r.page_id: (r.archive, r.expected_sha256 is None, r.actual_sha256) for r in audit(original, hurt).collect()}
    assert found == {77: (0, False, hashlib.sha256(b"zz").hexdigest()), 130: (1, False, None), 299: (2, False, None)}
    gone = audit(original, original.where("archive <> 1")).collect()
    assert {r.page_id for r in gone} == set(range(128, 256)) and all(r.actual_sha256 is None for r in gone)
    empty = write_archives(records(pages.limit(0)))
    assert audit(empty, empty).count() == 0 and audit(original, empty).count() == len(rows)
    back = sorted((r.record_id, r.url, bytes(r.content).decode()) for r in read_archives(original).collect())
    assert back == sorted((f"<urn:page:{'' if i is None else i}>", u or "", h or "") for i, u, h, _, _ in rows)
    assert read_archives(hurt).where("content is null").count() == 3
    for archive in (0, 1, 2):
        at = 0
        for r in original.where(f"archive = {archive}").orderBy("record_no").collect():
            assert r.offset == at
            at += r.length


def test_archives_of_repeated_and_missing_ids_are_bounded(spark):
    from skarn.llm.warc import audit, records, replicated, write_archives

    rows = [(None, "u", "same")] * 300 + [(4, "u", "same")] * 200 + [(i, "u", "x") for i in range(8, 24)]
    made = records(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), archive_ids=8)
    sizes = {r.archive: r["count"] for r in made.groupBy("archive").count().collect()}
    assert max(sizes.values()) <= 32 and len(sizes) > 50 and sum(sizes.values()) == len(rows)
    original = write_archives(made)
    copy = replicated(original, lambda page, data: None if page is None else data)
    assert audit(original, copy, fanout=2).count() == 300
