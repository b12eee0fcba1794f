import json

import pytest

from fixtures import layout, rolls, sample, titles
from leafwork.plans.convert import Options, convert
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def book(spark):
    return layout(spark, sample(), titles(), rolls())


def entries(book, **options):
    return {r["doc_id"]: (json.loads(r["entry"]), r) for r in convert(book, Options(**options)).collect()}


def contents(entry):
    return "\n".join(p["text"]["content"] for p in entry["pages"])


@pytest.fixture(scope="module")
def by_page(book):
    return entries(book)


def test_pages_and_names(by_page):
    entry, row = by_page["sample"]
    assert entry["name"] == "Aventura de Teste" and row["slug"] == "sample"
    assert [p["name"] for p in entry["pages"]] == ["Capítulo Um", "Tabela de Encontros", "Página 3"]
    assert [p["sort"] for p in entry["pages"]] == [100000, 200000, 300000]
    assert entry["folder"] is None


def test_text(by_page):
    text = contents(by_page["sample"][0])
    assert "velha biblioteca antes" in text and "procuram por uma pista sobre o culto que assombra a cidade" in text
    assert "<h2>A Biblioteca Orne</h2>" in text and "<li>Livros antigos</li>" in text
    assert "<blockquote><h4>Nota do Guardião</h4>" in text
    assert "Livro" not in text.replace("Livros", "")
    assert "<th>1D6</th>" in text and "<td>Ratos</td>" in text and "<em>Um texto em itálico.</em>" in text
    assert "leafwork/sample/sample-p002-01.webp" in text


def test_no_split_without_images(book):
    pages = book.pages.where("page_no > 0").select("doc_id", "page_no", F.col("page_no").alias("sel_ord"))
    entry, row = entries(book.select(pages), split="none", images=False)["sample"]
    assert len(entry["pages"]) == 1 and "<img" not in contents(entry) and row["n_images"] == 0


def test_heading_split(book):
    entry, _ = entries(book, split="heading", split_level=2)["sample"]
    assert [p["name"] for p in entry["pages"]] == ["Capítulo Um", "A Biblioteca Orne", "Tabela de Encontros"]


def test_repeated_title_kept_once(book):
    text = contents(entries(book, split="none")["mitos"][0])
    assert text.count("Criaturas dos Mitos") == 1 and "página 3" in text


def test_rolls_and_links(by_page):
    entry, _ = by_page["rpg"]
    text = contents(entry)
    assert "@coc7.check[subtype:skill,name:Encontrar,difficulty:+,poolModifier:+1]" in text
    assert "@coc7.sanloss[sanMin:0,sanMax:1D6]" in text and "@coc7.check[subtype:characteristic,name:str]" in text
    assert f"@UUID[.{entry['pages'][0]['_id']}]{{Insanidade}}" in text
    assert f"@UUID[.{entry['pages'][1]['_id']}]{{página 42}}" in text
    assert "<thead><tr><th>Arma</th>" in text and "<th>FOR</th>" in text


def test_switches_off(book):
    text = contents(entries(book, rolls=False, links=False)["rpg"][0])
    assert "@coc7" not in text and "@UUID" not in text


def test_bad_options():
    with pytest.raises(ValueError):
        Options(split="chapter")


def test_a_world_s_images_and_boxes_over_pages(book):
    text = contents(entries(book, asset_prefix="worlds/arkham/leafwork/sample")["sample"][0])
    assert "worlds/arkham/leafwork/sample/sample-p002-01.webp" in text


def test_layouts_that_cannot_be_read(spark, tmp_path, capsys):
    from leafwork import cli
    from leafwork.sources.layout import LayoutError, read

    with pytest.raises(LayoutError, match="no table spans"):
        read(spark, str(tmp_path), "spans")
    spark.range(1).write.parquet(str(tmp_path / "docs.parquet"))
    with pytest.raises(LayoutError, match="lacks doc_id, title, n_pages"):
        read(spark, str(tmp_path), "docs")
    (tmp_path / "pages.parquet").write_text("no table")
    with pytest.raises(LayoutError, match="can't be read"):
        read(spark, str(tmp_path), "pages")
    assert cli.main([str(tmp_path)]) == 2 and "lacks" in capsys.readouterr().err
    (tmp_path / "worlds" / "Arkham").mkdir(parents=True)
    assert cli.main(["--list-worlds", "--data-dir", str(tmp_path)]) == 0 and capsys.readouterr().out == "Arkham\n"
