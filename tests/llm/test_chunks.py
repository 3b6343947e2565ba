"""The cuts between chunks of a host change no result of op7."""

import random

from wayglass.llm import html_text


def test_pages_beside_a_cut_are_compared(spark, monkeypatch):
    rnd = random.Random(5)
    rows, body = [], ""
    for i in range(60):
        if rnd.random() < 0.6 and not 20 <= i < 32:  # runs of equal pages, one longer than chunks
            body = f"<p>menu {i // 7}</p><p>words {i} of this page</p><p>shared {i // 2}</p>"
        rows.append((i, f"http://a.example/p{i:03d}", body))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = lambda: {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    whole = text()
    monkeypatch.setattr(html_text, "CHUNKS", 20)
    monkeypatch.setattr(html_text, "LEAST_CHUNK", 3)
    assert len(html_text.chunk_starts(html_text.placed(pages))["a.example"]) == 19
    assert text() == whole and len(whole) == 60
