"""HTML extraction on small pages, one for each branch."""

from parchemin.functions import html as H
from parchemin.plans import pipelines


def page(inner: str) -> str:
    return f"<html><body><header>tête</header><nav>menu</nav>{inner}<footer>pied</footer></body></html>"


def test_content_root_cascade():
    assert H.main_text(page('<div class="x region-content">a</div><main>b</main>')) == "a"
    assert H.main_text(page("<main>b</main><article>c</article>")) == "b"
    assert H.main_text(page('<article>c</article><div class="field-name-body">d</div>')) == "c"
    assert H.main_text(page('<div class="field-name-body">d</div>')) == "d"
    assert H.main_text(page("<p>e</p>")) == "e"


def test_noise_is_dropped():
    assert H.main_text(page('<main><script>x</script><div class="Breadcrumb top">y</div><p>z  w</p></main>')) == "z w"


def test_long_text_loses_its_middle():
    assert H.main_text("<main>" + "a" * 10 + "</main>", 4) == "aa\n[...]\naa"


def test_preview_has_title_and_800_words_of_the_uncut_text(spark, tables):
    words = [f"mot{k}" for k in range(1000)]
    html = "<html><head><title>Le titre</title></head>" + page(f"<main><header>bandeau</header><p>{' '.join(words)}</p></main>")
    assert H.preview(html) == "Titre: Le titre\n\n" + " ".join(words[:800])
    assert H.preview(page("<main><h1>Un <b>sujet</b></h1><p>a</p></main>")) == "Titre: Un sujet\n\nUn sujet a" and H.preview(None) == "Titre: \n\n"
    rows = pipelines.ht_preview(spark, tables).collect()
    assert all(r.preview.startswith("Titre: ") for r in rows) and max(len(r.preview.split()) for r in rows) > 51


def test_null_and_broken_pages():
    assert H.main_text(None) == ""
    assert H.main_text("<p>a<p>b</div></main>") == "a b"
    assert H.main_text("<p>" * 5000 + "a") == "a"


def test_sections_and_tables():
    found = H.sections(page("<main><h2>T</h2><p>a</p><table><tr><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table><p>b</p><ul><li>c<p>d</p></li></ul><table><tr><td>solo</td></tr></table></main>"))
    assert [(s["text"], s["heading"], s["rows"]) for s in found] == [("T a", "T", None), ("", "T", [["x", "y"], ["1", "2"]]), ("b c d", "T", None), ("solo", "T", None)]


def test_links_are_resolved_once():
    html = '<a href="/x#top">1</a><a href="/x">2</a><img src="i.png"><iframe src="https://o.example/v"></iframe><a href="mailto:a@b">m</a>'
    assert H.links(html, "https://s.example/a/b") == [("link", "https://s.example/x"), ("image", "https://s.example/a/i.png"), ("frame", "https://o.example/v")]
    assert H.links(html, "https://s.example/a/b", "s.example") == [("link", "https://s.example/x"), ("image", "https://s.example/a/i.png")]


def test_three_kinds_of_dates():
    html = '<time datetime="2023-01-02T10:00">x</time><p class="date">5 Septembre 2024</p><span class="element-date">Publié le 26/01/2026</span><p class="date">5 truc 2024</p>'
    assert H.page_dates(html) == ["2026-01-26", "2024-09-05", "2023-01-02"]
