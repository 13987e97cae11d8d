"""Inspected examples, by kind and family, from which mixture components start and by which they are named.

Invented texts; each tuple is one family and gives one component. ``REPEATED`` and the like are spelled as rules.
"""

_DUMP = "\n".join(f"{i * 16:08x}  " + " ".join(f"{(i * 37 + j * 91 + 13) % 256:02x}" for j in range(16)) for i in range(8))
_NUMBERS = " ".join(str((i * 7919 + 104729) ** 2 % 10 ** (2 + i % 8)) for i in range(90))
_LETTERS = "qwzkvjxbnmtrlpaoeiuygdhfsc"
_RANDOM = " ".join("".join(_LETTERS[(i * 11 + j * j * 7 + i * j) % 26] for j in range(2 + (i * 5) % 10)) for i in range(40))
_BASE64 = "\n".join("".join("AbCdEfGhIjKlMnOpQrStUvWxYzaBcDeFgHiJkLmNoPqRsTuVwXyZ0123456789+/"[(i * 29 + j * j * 17 + j * i * 5) % 62] for j in range(76)) for i in range(5))
_SYMBOLS = "".join("#$%&*+/<=>@[]^_{|}~;:-!?().\n "[(i * 13 + i * i * 7) % 30] for i in range(300))
_BOXES = "".join("■▓░☐→✨🔥😀 ​"[(i * 7 + i * i * 3) % 10] for i in range(160))
_CODE = "".join(f"var a{i % 7}=b{i % 5}.c{i % 3}({i});if(!a{i % 7}){{d{i % 4}=a{i % 7}||{{}}}};" for i in range(20))
_BROKEN = "".join(("Ã©", "â€™", "Ð½", "ï¿½", "ðŸ", "a", "Ã¼", "n", "�", " ", "Â ", "e")[(i * 5 + i * i) % 12] for i in range(140))
_SENTENCE = "Our small team keeps the garden open late, and visitors come by the river. "
_MENU = ("Home | About | Contact | Log in | Search | Help", "Next » | « Back | Print | Share | RSS | Menu", "Terms | Privacy | Imprint | Cookies | Sitemap")
_WORDS = ("lamp", "table plan", "old chair", "Check doors and windows", "[[blue-garden-path]]", "Kitchen list (new)", "paint", "green bucket", "brush handles", "water tap")
_GERMAN = ("alter Stuhl", "Garten", "Lampe, Tisch", "neuer Eimer", "Fenster", "Werkzeug")
_CELLS = ("garden", "412", "0.271", "2024-03-02", "yes", "-", "88%", "river", "91", "2023-11-20", "bridge", "0.004", "17%", "no", "", "633", "lamp", "5")
_ROWS = [tuple(_CELLS[(i * 5 + j * 7 + i * i) % 18] for j in range(4)) for i in range(11)]
_SCRAMBLED = "hte oldm na alwkde slwoyl acrsso teh rbdieg nda wtahced hte owats lfaot yb wehn lla fo hte cidhlern rna tsap mhi nda algeuhd ta shi hta"
_SCRAMBLED_TOO = "fi eth doro si poen ethn sboomdey sah eben eerh berofe su nad teh aplm no eth btael wsa ltef ubnrnigi lal tinhg by hte wneadrer owh eacm fomr teh ctiy"


def _lines(start: list[str], words: tuple[str, ...] = _WORDS, between: str = "\n") -> str:
    return between.join(s + w for s, w in zip(start, words * 4))


def _table(join: str, left: str = "", right: str = "", quote: str = "", width: int = 0) -> list[str]:
    return [left + join.join(quote + c.ljust(width) + quote for c in row) + right for row in _ROWS]


def _figures(join: str, left: str = "", right: str = "", quote: str = "", columns: int = 6, rows: int = 9) -> list[str]:
    """Rows of figures, dates and shares, now and then a word or an empty cell."""
    cells: list[str] = []
    for i in range(columns * rows):
        cells.append((f"0.{i * 37 % 900 + 100}", f"202{i % 5}-0{i % 9 + 1}-1{i % 10}", f"{i * 13 % 100}%", str(i * 71 % 900), ("", "stone", "yes", "-")[i // 5 % 4])[i % 5])
    return [left + join.join(quote + c + quote for c in cells[r * columns : (r + 1) * columns]) + right for r in range(rows)]


EXAMPLES: list[tuple[str, list[str]]] = [
    ("prose", [
        "The bridge was closed in the spring because the river had risen above the lower stones. Nobody in the village remembered such a flood, and the old "
        "mill lost two of its wheels. When the water fell, we walked along the bank and counted what was left.\n\nMost of the gardens had been washed away, "
        "although the orchard behind the church was still standing. The reason is simple: it lies a little higher than the rest.",
        "We asked the builder for a new plan. He drew it on the back of a letter, and it was better than the one before. In practice the roof had to wait, "
        "which means that the rooms under it stayed wet until the summer came.",
    ]),
    ("prose", ["If the door is open, then somebody has been here before us.", "The small team repaired the boat last week.", "There are fresh apples in almost every basket, and nobody counts them."]),
    ("prose", [
        "we thought that the train would be late but it came on time and the whole group had to run the old man with the red bag was the last one to get in "
        "and he laughed all the way to the city because he had never been so fast in his life",
        "when the rain stops the children go out to the yard and play until it is dark nobody calls them and that is why they stay so long",
    ]),
    ("prose", ["the old man closed the window after the rain", "we moved the small boat and left the net alone", "el barco nuevo llega después de la lluvia", "der alte Mann schließt das Fenster nach dem Regen"]),
    ("prose", [
        "Der alte Garten liegt hinter dem Haus und ist im Sommer fast immer offen. Wir haben die Bank in dieser Woche gestrichen, weil sie zu rau war. "
        "Danach kommt niemand mehr am Abend. Ohne einen neuen Zaun läuft der Hund auf die Straße.",
        "Es zeigte sich, dass der Weg nicht breit genug ist. Der Nachbar hat ihn nach dem Regen geprüft und will ihn vor dem Winter befestigen.",
    ]),
    ("prose", [
        "Le vieux pont reste fermé pendant la semaine, car la rivière est trop haute. Nous avons vu que le jardin est sous l'eau, même s'il est entouré d'un mur. "
        "Ensuite, personne ne passe plus par le village avant le soir.",
        "El puente viejo está cerrado esta semana, porque el río es demasiado alto. Después nadie pasa por el pueblo en mayo. Vimos que la casa no tiene puerta, aunque sea nueva.",
    ]),
    ("prose", [
        "guest: We looked at the room and it was far too small for all of us.\nhost: There is another one behind the kitchen, which is a little larger.\n"
        "guest: Then we would like to see that one before we decide.\nhost: It has two windows, and the view is better than from here.",
    ]),
    ("prose", [
        "# A short walk\n\nThe path begins at the church and follows the wall for a while. It is easy to miss the gate, because it is hidden behind a tree.\n\n"
        "Take with you:\n\n- water\n- a coat\n- some bread\n\nFrom the gate it is an hour to the lake. When the weather is good, the boats go out until the evening, and one can "
        "cross to the other side. We went there twice and were never alone.",
        "---\ntitle: the lake\nstatus: open\n---\nThe lake is at its best in the autumn, when the visitors have left. We assumed that the boats would be gone, but the owner keeps one for "
        "those who ask. In practice nobody asks, and that is why it is always free.",
    ]),
    ("list", [_lines(["- "] * 10), _lines(["* ", "  * ", "    * ", "* ", "* "] * 2), _lines(["+ "] * 8), _lines(["• "] * 6, _GERMAN), _lines(["→ "] * 9), _lines(["– "] * 7)]),
    ("list", [_lines([f"{i}. " for i in range(1, 11)]), _lines([f"({i}) " for i in range(1, 10)]), _lines([f"{c}. " for c in "abcdefgh"], _GERMAN), _lines([f"[{i}] " for i in range(1, 9)]), _lines([f"{i}) " for i in range(1, 12)])]),
    ("list", [_lines(["- [ ] ", "- [x] "] * 5), _lines(["✓ "] * 8)]),
    ("list", [_lines([""] * 10), _lines([""] * 8, _GERMAN), "To buy:\n" + _lines([""] * 9)]),
    ("list", [_lines([""] * 9, between="\n\n"), _lines([""] * 6, _GERMAN, "\n\n")]),
    ("list", [_lines([""] * 24, between="; "), _lines([""] * 20, between=" · "), _lines([""] * 18, between=", "), _lines([""] * 12, between=" / ")]),
    ("table", ["\n".join(["| a | b | c | d |", "| --- | --- | --- | --- |", *_table(" | ", "| ", " |")])]),
    ("table", ["\n".join(["+------+------+------+------+", *_table("|", "|", "|", width=10), "+------+------+------+------+"]), "\n".join(_table(" │ ", "│ ", " │", width=9))]),
    ("table", ["\n".join(_table(","))]),
    ("table", ["\n".join(_table(";", quote='"')), "\n".join(_table(","  , quote='"'))]),
    ("table", ["\n".join(_table("\t")), "\n".join(_table("  ", width=12))]),
    ("table", ["\n".join(["| mill | roof | stone | bridge | field | well |", "| --- | --- | --- | --- | --- | --- |", *_figures(" | ", "| ", " |")])]),
    ("table", ["\n".join(_figures(";", quote='"', columns=4)), "\n".join(_figures("\t", columns=4))]),
    ("junk", [_DUMP]),
    ("junk", [_NUMBERS]),
    ("junk", [_RANDOM]),
    ("junk", [_BASE64]),
    ("junk", [_SYMBOLS]),
    ("junk", [_BOXES]),
    ("junk", [_CODE]),
    ("junk", [_BROKEN]),
    ("junk", ["garden\n" * 60, "bridge " * 80, "lamp, " * 50]),
    ("junk", [_SENTENCE * 30, (_SENTENCE.strip() + "\n") * 20]),
    ("junk", [" ".join(_SENTENCE.replace(" ", "")) + " " + " ".join(_SENTENCE.replace(" ", ""))]),
    ("junk", ["\n".join(_MENU * 2), _MENU[1] + "\n" + _MENU[0]]),
    ("junk", [_SCRAMBLED, _SCRAMBLED_TOO]),
]
