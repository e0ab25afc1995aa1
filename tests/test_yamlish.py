"""Front matter: reading against a YAML library where there is one, writing, round trips."""

import random
import string

import pytest

from dossierflow.functions import yamlish

CARD = """# comment
tipo: cliente
nome: Rossi:e figli SRL   # not a key
piva: 03421560289
quote: "con \\"virgolette\\" e \\n"
apice: 'l''altro'
telefono: +39 0444 123456
relazione_dal: 2018-03
url: http://x.it/a#b
condizioni:
  sconto: 12%
  fondo:
    n: 1
    voci: [a, "b, c", 3, {k: v}]
eccezioni:
  - data: 2023
    contesto: ordine urgente
    righe:
    - 1
    - due
  - data: null
    vuoto:
  -
    solo: x
prodotti:
- lamiere acciaio
- - x
  - y
- 'tre'
note: |
  Prima riga.
    rientrata

  ultima: riga
piegata: >-
  una
  frase

  altra
tieni: |+
  fine

lungo: una frase che
  continua qui
  e qui
vuota: []
mappa: {}
si: yes
no_: off
numero: 1_000
virgola: 1.5
"""


def test_a_card_is_read_as_yaml():
    yaml = pytest.importorskip("yaml")
    want = yaml.safe_load(CARD)
    assert yamlish.load(CARD) == want


def test_errors_say_where():
    for text, part in (("a: 1\n\tb: 2", "tab"), ("a: 1\n   b: 2", "nowhere"), ("a: [1, 2", "closed"), ("a: *x", "not read"), ("a: 1\nplain", "no `key"), ('a: "x', "quotes")):
        with pytest.raises(yamlish.YamlError, match=part):
            yamlish.load(text)


def anything(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind >= 7:
        return {rng.choice(["a", "b c", "k-1", "è", "1", "x: y", "yes"]): anything(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == 6:
        return [anything(rng, depth + 1) for _ in range(rng.randrange(4))]
    text = "".join(rng.choice(string.ascii_letters[:6] + " -:#'\"{}[],&*!|>%@`~.\\0123\néß") for _ in range(rng.randrange(12)))
    return [rng.randrange(-5, 2000), rng.choice([True, False, None]), text, rng.choice([1.5, -0.25, 100.0]), rng.choice(["true", "12", "1.5", "null", "2023-01-02", "", " x", "x ", "- a", "a: b", "a #b", "#", "è\nù\n", "a\n\n", "\nb", "x:", "0x1f", "1:30", "=", "<<", "~"]), "plain text"][kind]


def test_what_is_written_is_read_again():
    rng = random.Random(11)
    for k in range(3000):
        value = {f"k{i}": anything(rng) for i in range(rng.randrange(1, 5))}
        text = yamlish.dump(value)
        assert yamlish.load(text) == value, (k, value, text)


def test_writing_equals_the_library():
    yaml = pytest.importorskip("yaml")

    class Dumper(yaml.SafeDumper):
        pass

    Dumper.add_representer(str, lambda d, s: d.represent_scalar("tag:yaml.org,2002:str", s, style="|" if "\n" in s else None))
    value = {"tipo": "cliente", "nome": "A & B", "piva": "0342", "anno": "2023-01-02", "n": 3, "q": 1.5, "si": True, "no": None, "vuoto": "", "l": [], "m": {}, "cond": {"x": "12%", "y": {"z": ["a", "b: c"]}}, "ecc": [{"data": "d", "voci": [1, 2]}, {"k": "v"}], "note": "riga\naltra\n", "senza": "riga\naltra", "u": "http://x", "t": "+39 044", "s": "'ap", "d": "- x"}
    assert yamlish.dump(value) == yaml.dump(value, Dumper=Dumper, sort_keys=False, allow_unicode=True, width=120)
    rng = random.Random(12)
    for _ in range(2000):
        value = {f"k{i}": anything(rng) for i in range(2)}
        assert yaml.safe_load(yamlish.dump(value)) is not None
        again = yaml.safe_load(yamlish.dump(value))
        assert again == value, (value, yamlish.dump(value))


def test_keys_come_in_their_order():
    assert yamlish.dump({"z": 1, "b": 2, "a": 3}, ["a", "x", "b"]) == "a: 3\nb: 2\nz: 1\n"
    assert yamlish.dump({}) == ""
