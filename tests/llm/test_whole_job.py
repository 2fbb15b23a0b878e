"""Cases in which an operator once did less than the whole job."""

import zlib

import numpy as np
import pytest

from geoloom.llm import decontam, packing, queries, substring, wrapper

SPECIAL = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n 's  ", "<|endoftext", "<|im_end|> é", "plain text", "w <|endoftext|>" * 900]


@pytest.mark.parametrize("stage", ["op9", "pipeline"])
def test_packing_takes_added_tokens_as_tokenizers_does(spark, tmp_path, stage):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_best_fit_packing(spark, str(tmp_path)) if stage == "op9" else corpus_pipeline.packing_stage(spark, docs, "")
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.collect()}
    want = {}
    for doc, text in enumerate(SPECIAL):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [packing.END_ID], "<u4")
        for k, (a, n) in enumerate(packing.cuts(len(ids), packing.CAPACITY)):
            want[doc, k] = (a, n, zlib.crc32(ids[a : a + n].tobytes()))
    assert got == want


def text_of(page):
    return wrapper.extract(page, None, [], 0)


@pytest.mark.parametrize(
    "before",
    [
        "<script>for(i=0;i<n ;i++){} // don't</script>",
        "<script>a = '<!--'</script>",
        "<style>a<b 'c</style>",
        "<svg class=x />",
        "<svg><path d=1>",
        "<object data=x>",
        "<noscript>",
        "<noscript/>",
        "<svg/><svg><text>no</text></svg>",
        "<svg><svg><text>no</text></svg><text>no</text></svg>",
        "<svg><script>'</svg>'</script><text>no</text></svg>",
        "<title/>",
        "<div>" * 300,
        "<div>" * 300 + "</div>" * 300,
    ],
)
def test_html_keeps_the_article(before):
    assert text_of(before + "<article><p>First one.</p><p>Here it's more.</p></article>") == "First one. Here it's more."


def test_html_deep_elements_close_themselves():
    deep = "<div>" * 5000
    page = f"<article>{deep}<section>in</section>{'</div>' * 5000}<p>after</p></article><footer>no</footer>"
    assert text_of(page) == "in after"
    tree = wrapper.parse(page)
    assert len(wrapper.align(tree, wrapper.parse(page))) == len(wrapper.number(tree)) == 5000 + 5


def test_html_of_an_unclosed_script_is_left_out():
    assert text_of("<p>text</p><script>var a = 1; <p>code</p>") == "text"


def site(k):
    return f"<html><head><title>t</title></head><body><div class=box>Same words on each page</div><div class=story><h1>Title {k}</h1><p>Story {k} has its own text {k * 7}.</p></div><div class=end>The end</div></body></html>"


@pytest.mark.parametrize("first", [None, "", "cut off", "<html><head><title>t", "<html><head></head><body><div class=box>Same words", "<html><body><p>Another kind of page</p></body></html>"])
def test_wrapper_of_a_host_with_a_damaged_first_page(spark, first):
    rows = [(0, "http://h/0", first)] + [(k, f"http://h/{k}", site(k)) for k in range(1, 14)] + [(None, "http://null/", None), (50, "http://null/", "")]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 16 and got[50] == got[None] == ""
    assert all(got[k] == f"Title {k} Story {k} has its own text {k * 7}." for k in range(1, 14))


def test_wrapper_without_a_usable_reference_takes_the_page_s_own_root():
    page = "<html><body><div>a b</div><article><p>The text of the page.</p></article></body></html>"
    ref = wrapper.number(wrapper.parse(""))
    assert wrapper.extract(page, ref, [False], -1) == "The text of the page."


@pytest.mark.parametrize("one", [None, 7])
def test_spans_stay_with_their_row(spark, one):
    shared = " ".join(f"s{k}" for k in range(20))
    own = " ".join(f"o{k}" for k in range(60))
    rows = [(1, shared), (one, f"{own} {shared} tail"), (one, " ".join(f"q{k}" for k in range(90))), (one, "short"), (one, None), (one, f"{own} {shared} tail"), (9, f"a {shared}"), (2, own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 4):
        got = sorted((str(r.text), r.n_removed, r.kept_text) for r in substring.remove_repeats(docs.repartition(n)).collect())
        want = {rows[1][1]: (80, "tail"), rows[6][1]: (20, "a")}
        assert got == sorted((str(t), *want.get(t, (0, t or ""))) for _, t in rows)


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_finds_short_items(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    items = {m: " ".join(f"i{m}x{k}" for k in range(m)) for m in range(1, 13)}
    bench = spark.createDataFrame([*items.items(), (50, ""), (51, "!?"), (52, None), (53, items[3])], "item_id long, text string")
    rows = [(100 + m, f"Before it, {t.upper()}! after") for m, t in items.items()] + [(200, items[4]), (201, items[5].replace("i5x2", "other")), (202, "i6x0 i6x1 i6x2 i6x3 i6x4"), (203, ""), (204, None), (205, f"{items[1]} {items[2]} {items[1]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_tokens, r["at"]) for r in decontam.leaks(docs, bench).collect()}
    want = {(100 + m, m): (m, m, 2) for m in items} | {(103, 53): (3, 3, 2), (200, 4): (4, 4, 0), (205, 1): (1, 1, 0), (205, 2): (2, 2, 1)}
    assert got == want
    assert sorted(r.doc_id for r in decontam.without_leaks(docs, bench).collect()) == [201, 202, 203, 204]
