"""Small documents as layout tables, built from the descriptions of their content."""

from __future__ import annotations

from leafwork.plans.convert import Layout
from leafwork.sources.layout import SCHEMAS

PAGE = (0.0, 0.0, 612.0, 792.0)


class Book:
    def __init__(self, doc_id: str, title: str):
        self.doc_id, self.title = doc_id, title
        self.rows = {k: [] for k in SCHEMAS}
        self.block = 0

    def page(self):
        no = len(self.rows["pages"])
        self.rows["pages"].append((self.doc_id, no, no, *PAGE))
        self.no = no
        return self

    def text(self, x, y, *lines, size=10.0, bold=False, italic=False, step=None, font="Serif", direction=(1.0, 0.0), width=0.5):
        """A block of lines, y is the first baseline; a line is a string or a list of (x, text) spans."""
        x, y, step = float(x), float(y), step or size * 1.2
        for i, line in enumerate(lines):
            base = y + i * step
            spans = [(x, line)] if isinstance(line, str) else line
            boxes = [(float(sx), base - 0.8 * size, sx + width * size * len(t), base + 0.2 * size) for sx, t in spans]
            whole = (min(b[0] for b in boxes), boxes[0][1], max(b[2] for b in boxes), boxes[0][3])
            for k, ((_, t), b) in enumerate(zip(spans, boxes, strict=True)):
                self.rows["spans"].append((self.doc_id, self.no, self.block, i, k, t, font, float(size), 16 * bold + 2 * italic, *direction, *b, *whole))
        self.block += 1
        return self

    def grid(self, rect, rows):
        self.rows["grid_tables"].append((self.doc_id, self.no, len(self.rows["grid_tables"]), *map(float, rect), rows))
        return self

    def image(self, rect, digest):
        self.rows["image_infos"].append((self.doc_id, self.no, len(self.rows["image_infos"]), digest, 1, *map(float, rect)))
        return self

    def drawing(self, rect, fill=None, color=None, ops=("re",)):
        self.rows["drawings"].append((self.doc_id, self.no, len(self.rows["drawings"]), *map(float, rect), fill, color, list(ops)))
        return self


def layout(spark, *books: Book) -> Layout:
    def frame(name):
        rows = [r for b in books for r in ([(b.doc_id, b.title, len(b.rows["pages"]))] if name == "docs" else b.rows[name])]
        return spark.createDataFrame(rows, SCHEMAS[name])

    return Layout(**{k: frame(k) for k in SCHEMAS})


def sample() -> Book:
    """Three pages: headings, a hyphen over lines, a paragraph over columns, bullets, a box, a table, an image."""
    b = Book("sample", "Aventura de Teste")
    for n in (1, 2, 3):
        b.page()
        b.text(54, 30, "Aventura de Teste - Livro", size=8).text(300, 768, str(n), size=8)
        if n == 1:
            b.text(54, 80, "Capítulo Um", size=24, bold=True)
            b.text(54, 120, "Os investigadores chegam à velha bib-", "lioteca antes do anoitecer e procu-", "ram por uma pista sobre o culto que")
            b.text(315, 120, "assombra a cidade há muitos anos.", "Ninguém responde quando batem.")
            b.text(315, 200, "A Biblioteca Orne", size=15)
            b.text(315, 225, "• Livros antigos", "• Mapas", "• Cartas seladas")
            b.drawing((54, 330, 558, 420), fill=[0.9, 0.9, 0.8])
            b.text(60, 350, "Nota do Guardião", size=11, bold=True).text(60, 366, "Só leia isto em voz alta se os", "jogadores pedirem.")
            b.text(54, 450, "A noite cai sobre a cidade inteira.")
        elif n == 2:
            b.text(54, 80, "Tabela de Encontros", size=15)
            b.grid((54, 95, 354, 167), [["1D6", "Encontro"], ["1-2", "Ratos"], ["3-4", "Vigia"], ["5-6", "Nada"]])
            b.image((54, 200, 254, 320), "map")
            b.text(54, 350, "Um texto depois da imagem.").text(54, 380, "Um texto em itálico.", italic=True)
        else:
            b.text(54, 120, "O fim da aventura chega depressa.")
    return b


def titles() -> Book:
    """Three pages that begin with the same title in the body."""
    b = Book("mitos", "Mitos")
    for n in (1, 2, 3):
        b.page().text(54, 130, "Criaturas dos Mitos", size=20, bold=True)
        b.text(54, 170, f"O texto da página {n} começa aqui e segue.", f"E termina na página {n}.", step=15)
    return b


def rolls() -> Book:
    """Rolls, losses, and references by heading and printed page."""
    b = Book("rpg", "Bestiário de Teste")
    for n in (1, 2, 3):
        b.page().text(54, 36, "Bestiário", size=14).text(300, 768, str(40 + n))
        if n == 1:
            b.text(54, 100, "Insanidade", size=24)
            b.text(54, 140, "Peça um teste Difícil de Encontrar, com um dado de bônus, e veja Insanidade (ver página 42).", "Quem falha faz um teste de Sanidade (0/1D6) e um teste de FOR no fim.")
        elif n == 2:
            b.text(54, 100, "Ataques", size=24)
            b.text(54, 140, [(54, "Arma"), (200, "Perda de SAN"), (320, "Dano")], bold=True)
            b.text(54, 152, [(54, "Garra"), (200, "0/1D6"), (320, "1D4")], [(54, "Mordida"), (200, "1/1D8"), (320, "2D6")])
            b.text(54, 300, "Corpo do texto em uma linha longa para ser o texto comum do livro inteiro.")
        else:
            b.text(54, 140, "FOR 50 CON 60 TAM 70 DES 40 INT 30 POD 55", "")
            b.text(54, 300, "Outra linha comum de texto que apenas encerra o bestiário de teste.")
    return b
