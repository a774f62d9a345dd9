"""The small labelled table that the model of ``pii`` is trained from.

A row is a line of words with its labelled spans. It is put together at random from three things, none of which comes from
a corpus: values that follow the public forms of e-mail addresses, telephone and identity numbers, postal addresses and
personal names; words that announce such a value in several languages; and filler, which is drawn from the words of a
public tokenizer's vocabulary or made up of syllables. A frame says in which order they come and has no run of three
literal words, so that a sentence of a corpus can't be learned by heart.
"""

from __future__ import annotations

import random
import re

#: Common given names of English, German, French, Spanish, Italian, Nordic, Slavic, Arabic and African use.
GIVEN = """
mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret betty sandra ashley emily
donna michelle carol amanda melissa deborah laura rebecca sharon cynthia amy kathleen angela emma olivia grace alice
james robert john michael david william richard joseph thomas charles daniel matthew anthony mark paul steven andrew
kenneth george edward brian kevin jason ryan jacob peter henry adam oliver harry simon philip stephen martin oscar
anna maria julia sophie lena hannah petra monika sabine ursula heike ingrid stefan klaus jürgen wolfgang hans karl
dieter uwe matthias sebastian florian lukas jan marie camille claire juliette isabelle nathalie pierre jean jacques
luc antoine nicolas françois lucia carmen ana elena sofía isabel pilar josé juan carlos luis miguel javier pedro
diego pablo giulia chiara francesca marco luca giovanni paolo alessandro astrid freya sigrid erik lars anders björn
søren magnus olga natasha irina ivan dmitri sergei piotr jakub fatima aisha leila ahmed omar ali hassan yusuf amina
kwame chidi ngozi wei mei hiroshi yuki priya raj arjun
""".split()

#: Those that are words too.
GIVEN_WORDS = "mark grace jean wei mei".split()

#: Words for streets.
STREET_EN = "Street St. St Road Rd Lane Ln Drive Dr Avenue Ave. Ave Terrace Close Row Square Court Way Boulevard Place Crescent Hill Gardens".split()
STREET_DE = "straße weg platz gasse allee ring ufer strasse str.".split()
STREET_ROMANCE = "Calle Avenida Plaza Rue Via Viale Piazza Rua Carrer Paseo".split()

#: Words that announce a value of each type, and words that announce a number of another kind.
CUES = {
    "email": "email e-mail mail mailto contact write reach inbox address correo schreib schreibt mailadresse courriel écris écrivez escribe escríbeme skriv posta correio kontakt".split(),
    "phone": "phone call ring text mobile cell tel telephone number whatsapp signal sms fax dial reach handy telefon mobil rufnummer anrufen ruf móvil teléfono llama llámame téléphone numéro portable appelle telefono chiama cellulare telefoon bel".split(),
    "id_number": "ssn social security passport identity id licence tax national insurance nino dni nie nif card karte carte tarjeta ausweis personalausweis reisepass steuer-id sozialversicherung pasaporte identidad passeport identité fiscale cpf bsn personnummer".split(),
    "address": "address live lives living house home flat apartment moved send parcel deliver ship visit lodge wohne wohnt adresse anschrift lieferung dirección vivo vive domicilio habite habita indirizzo abito adres woon residence office pickup".split(),
    "person_name": "name named called signed regards sincerely mr mrs ms dr prof herr frau señor señora monsieur madame heiße heißt nombre llamo appelle nom gruß grüße saludos cordialement author written met know meet ask boss neighbour landlord teacher doctor lawyer seller sold pay paid yours chiamo naam".split(),
    "other": "isbn serial order invoice part version build firmware model tracking ticket error code port page room posts thread file bytes price cost total year resistor train track checksum sku item lot batch step chapter issue unix released dump sum seed".split(),
}

#: Words that link a cue and a value.
LINKS = {
    "my": "my his her our their your the mi su mein meine sein ihr mon ma son mijn mio meu a".split(),
    "is": "is was are es ist war est era è é lautet remains".split(),
    "no": "no no. number nr nr. num # nummer número numéro code".split(),
    "by": "by from with for to of von an mit para por de par pour avec da per".split(),
    "in": "at in to from near on bei in nach en à aan".split(),
    "kind": "edition station team kit brand series museum company brothers soundtrack poll casing script festival engine league catalogue model pack club".split(),
    "unit": "bytes posts days hours euros dollars km kg pages people watts volts items seconds copies parts mm".split(),
    "det": "the a an this that der die das ein eine im am vom el la los un una le les des il".split(),
}

#: Frames of lines that hold personal data: {e} e-mail, {p} phone, {i} id number, {I} one whose form says so, {a} address,
#: {n} person, {N} one of a common given name, {l} the same in lower case; {ce} and so on a word that announces it; {w} filler, {X} a made-up name, {C} a capitalised word, {G} a
#: given name, {d3} three digits; others as in LINKS.
FRAMES = """
{e}|{ce} {e}|{ce}: {e}|{my} {ce} {is} {e}|({e})|{w} {e} {w}|{ce} {w} {e}|{e} , {w} {w}|{ce} {by} {e}|{w} {w} {e}|{e} {w} {w}|{ce} {w} {in} {e}|{ce} {w} {w} {e}|{e} {w} {w} {w} {w}
{p}|{cp} {p}|{cp}: {p}|{my} {cp} {is} {p}|{w} {p}|{cp} {w} {p}|{p} {w} {w}|{p} , {w} {w}|{cp} {in} {p}|{w} {cp} {p} {w}|{w}, {p}|{G} {p}|({p})|{cp} {w} {w} {p}|{cp} {w} {in} {p} {w}
{ci} {i}|{ci}: {i}|{ci} {no} {i}|{my} {ci} {no} {is} {i}|{ci} {w} {i}|{my} {ci} {is} {i}|{ci} {i} {w} {w}|{w} {ci} {i}|{ci} {is} {i}|{I}|{w} {I} {w}|{my} {ci} {w} {is} {i}|{ci} {w} {w} {i}|{my} {ci} {w} {w} {i}|{my} {w} {ci} {i} {w}
{ca} {a}|{ca}: {a}|{a}|{my} {ca} {is} {a}|{ca} {in} {a}|{ca} {w} {in} {a}|{w} {in} {a}|{w} {w} {a} , {w} {w}|{a} {w}|{w} {ca} {a}|{w} {a} {w} {w}|{G} {ca} {a}|{ca} {w} {w} {a}
{cn} {n}|{cn}: {n}|{my} {cn} {is} {n}|{cn} {by} {n}|{N}|{w} {by} {N}|{w} {w} {by} {N} {w} {w}|{N} {w} {w}|{w} {N} , {w} {w}|- {N}|{cn}, {n}|{w} {w} {N}|{w} {cn} {n} {w} {w}|{C} {by} {N}|{w} {is} {N} , {w}|{cn} {w} {N}|{cn} {w} {n}|{cn} {w} {by} {n}|{cn} {n} {w} {w}|{my} {w} {cn} {is} {n}|{cn} {n} {in} {w}
{cn} {l}|{my} {cn} {is} {l}|{cn} {by} {l}|{w} {by} {l}|{cn}, {l}|{w} {cn} {l} {w}|{w} {w} {l} {w}|{l} {w} {w}|{w} {by} {l} , {w}|{cn} {w} {l}
{N} {cp} {p}|{ce} {e} {cp} {p}|{N} {ca} {in} {a}|{ci} {i} {cp} {p}|{N} , {a}|{N} ({e})|{cn} {n} {ci} {i}
""".strip()

#: Frames of lines without personal data.
NEITHER = """
{cx} {num}|{cx}: {num}|{cx} {no} {num}|{det} {cx} {w} {num}|{num} {unit}|{num} {unit} {in} {num} {unit}|{w} {num} {w}|{cx} {w} {num}|{w} {cx} {num} {w}|{X}-{d3}-{d4}|{cx} {X}-{d3}-{d4}|{num}|{w} {is} {num} {w}|{X} {d3} , {w}|{C} {num}
{w}@{w}|@{w} {w}|{w}@{d1}x.png|{w}@{X} {w}|{cx} {d3} {in} {X} {st} {kind}|{in} {X} {st}|{X} {st} {w} {w}|{cx} {d2} {in} {det} {X} {st} {kind}|{w} {w} {X} {st}|{w}@{d1}x.jpg {is} {w}|{w} @ {w}
{det} {X} {X} {kind}|{X} {X} {w} {det} {w}|{w} {by} {X}|{X} {by} {X}|{w} {by} {X} {w} {w}|{X} , {X} {and} {X}|{X} {and} {X} {w}|({X} {X} , {w} {w})|({X} {w} , {w} {w})|{kind} {X} {X} {X}|{w} {X} {kind}|{X} {X} {kind}|{det} {C} {w} {C}|{C} {w} {C} {X}|{det} {C} {by} {X}|{C} {C} {w}
{G}|{G} {w} {w}|{w} {G}|{w} {by} {G}|{G} {and} {G}|{w} {G} , {w}|{by} {G} {w} {w}|{cn} {G} {w} {w}|{det} {G} {w}|{G} {is} {w}|{cn} {w} {w}|{cn} {det} {w}|{cn} {by} {X}|{cn} {by} {det} {X} {kind}|{G}? {w} {w}
{w} {w} {w} {w} {w}|{C} {w} {w} {w} {w}|{w} {w} {X} {w} {w}|{w}, {w} {and} {w}|{C} {w} {w}! {C} {w}|{X} {w} {w} {w}|{w} {w}. {X} {w} {w}|{w} {w}? {C} {w}|{ca} {w} {w}|{ca} {in} {X}|{cp} {w} {w}|{ce} {w} {w}|{ci} {w} {w}|{cp} {G} {w}|{ca} {det} {w} {in} {X}
>>{d8}|>>>/{w}/{d8}|>>{d9} {w} {w}|>>0{d11}|>>00{d6} {w}|>>000{d9} {w} {w}|{cx} >>{d8}|{w} >>{d8}|{w}{d2}|{w}_{w}|{w}.{w}|{w}/{w}|{w}.{w}/{w}|{w}.com|{date} {w}|{w} {date}|{cx} {time} {w}|{w}.jpg|{d4}x{d4} {w}|{d1}. {w} {w}|{X} {d2}|{d3}% {w}|{C} {C} {kind}|{X} {C}
""".strip()

#: Frames of authors' names, with and without personal data.
AUTHORS = "{n}|{n}|{n}|{n}|{n}|{n}|{n}|{n}|{l}|{l}|{l}|{l}|{e}|{p}|{w} {p}|{n} {w}"
HANDLES = "{X} {w}|{det} {w} {w}|{X}|{G}|{w}{d2}|{w}|{X} {d2}|{w} {w} {w}|{w} {X}|{C}|{C} {w}|{w}_{w}|{G}{d2}|{G} {d2}|{w} {w}|OP|{C}{C}|{det} {X}"

_VOWELS = "a e i o u ae ei ou ai".split()
_ONSET = "b br c ch cl d dr f fl g gr h j k kl l m n p pl qu r s sk st t tr v vr w z".split()
_CODA = " ck d g l lm m n nd ng r rk s st t x zz rn".split(" ")
_ENDS = "son man ley ford well burn dale field wood stad mann berg heim ski eau ault ez ini ello ova sen ton worth by croft".split()
#: Digits as words in English, German, Spanish and French.
_SPOKEN = ("zero null cero oh", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")
DIGIT_WORDS = frozenset(w for line in _SPOKEN for w in line.split())


class Maker:
    """Makes values and lines; ``words`` and ``names`` are lower-case and capitalised words of a public vocabulary, the commonest first."""

    def __init__(self, seed: int, words: list[str], names: list[str]):
        self.r, self.words, self.names = random.Random(seed), words, names

    def syllables(self) -> str:
        r = self.r
        return "".join(r.choice(_ONSET) + r.choice(_VOWELS) + r.choice(_CODA) for _ in range(r.choice((1, 1, 2))))

    def common(self, words: list[str]) -> str:
        return words[int(len(words) * self.r.random() ** 3)] if words else self.syllables()

    def word(self) -> str:
        r = self.r.random()
        if r < 0.04:  # contractions
            return self.r.choice(["l'", "d'", "qu'", "jusqu'", "c'", "it'", "don'", "we'"]) + self.common(self.words)
        if r < 0.06:
            return self.r.choice(GIVEN_WORDS)
        return self.common(self.words) if r < 0.6 else self.syllables()

    def capital(self) -> str:
        return self.common(self.names) if self.r.random() < 0.5 else self.syllables().capitalize()

    def surname(self) -> str:
        r = self.r.random()
        if r < 0.25:
            return self.common(self.names)
        return (self.syllables() + (self.r.choice(_ENDS) if r < 0.7 else "")).capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def given(self) -> str:
        return self.r.choice(GIVEN).capitalize()

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTXYZ") for _ in range(n))

    def N(self) -> str:  # noqa: N802
        return self.n(True)

    def n(self, known: bool = False) -> str:
        r = self.r
        g = self.given() if known or r.random() < 0.5 else self.syllables().capitalize()
        s = self.surname()
        if r.random() < 0.12:
            s += "-" + self.surname()
        elif r.random() < 0.08:
            s = r.choice(["van ", "von ", "de ", "Mc", "O'"]) + s
        name = r.choice([f"{g} {s}"] * 7 + [f"{g} {self.letters(1)}. {s}", f"{self.letters(1)}. {s}", f"{self.letters(1)}. {s}", f"{s}, {self.given()}", f"{g} {self.given()} {s}", f"{r.choice(['Dr', 'Dr.', 'Prof.', 'Mr', 'Mrs', 'Ms', 'Herr', 'Frau'])} {g} {s}", f'{g} "{self.syllables()}" {s}', f"{g[0]}. {self.letters(1)}. {s}"])
        return name.upper() if r.random() < 0.1 else name

    def l(self) -> str:  # noqa: E743
        s = self.surname().lower()
        return f"{self.r.choice(GIVEN)} {s}" if self.r.random() < 0.9 else f"{self.letters(1).lower()}. {s}"

    def e(self) -> str:
        r = self.r
        g, s, w = r.choice(GIVEN), self.surname().lower(), self.word
        user = r.choice([f"{g}.{s}", f"{g[0]}{s}", f"{s}{self.digits(2)}", f"{g}_{s}", f"{g}+{w()}", w(), f"{w()}.{w()}", f"{w()}{self.digits(3)}", f"{g}-{s}"])
        host = r.choice([w(), f"{w()}-{w()}", f"{w()}.{w()}"]) + "." + r.choice("com org net edu de co.uk es fr it info io eu example test invalid".split())
        m, form = f"{user}@{host}", r.random()
        if form < 0.5:
            return r.choice([m, m, m, m.upper(), user.capitalize() + "@" + host, user.upper() + "@" + host.title()])
        at, dot = r.choice([("(at)", "."), ("[at]", "."), ("＠", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), (" AT ", " DOT "), (" at ", "."), ("{at}", "."), ("[at]", "[dot]"), (" @ ", ".")])
        return user + at + host.replace(".", dot)

    def p(self) -> str:
        d, r = self.digits, self.r
        s = r.choice("- . /".split() + [" ", " ", ""])
        v = r.choice([
            f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"+{r.randint(1, 99)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{r.randint(30, 49)} (0){d(2)} {d(4)} {d(3)}", f"+44 7{d(3)} {d(6)}", f"+44 7{d(3)} {d(3)} {d(3)}", f"07{d(3)} {d(6)}", f"07{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}",
            f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"00{r.randint(30, 49)}{s}{d(2)}{s}{d(8)}", f"0{d(3)}{s}{d(7)}",
            f"0{d(3)} {d(8)}", f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(4)}/{d(6)}", f"+{r.randint(30, 49)}{d(10)}", f"tel:+{d(11)}", f"({d(5)}) {d(6)}", f"(0{d(2)}) {d(4)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+{r.randint(30, 49)}-{d(3)}-{d(7)}", f"+{r.randint(30, 49)} {d(3)} {d(3)} {d(3)}",
        ])
        if r.random() < 0.15 and " " in v:  # some digits of a group spoken
            parts = v.split(" ")
            k, n = r.randrange(len(parts)), r.randint(1, 3)
            spoken = [r.choice(_SPOKEN[int(c)].split()) for c in parts[k][:n] if c.isdigit()]
            v = " ".join([*parts[:k], *spoken, parts[k][n:], *parts[k + 1 :]])
        return " ".join(v.split())

    def I(self) -> str:  # noqa: E743  (forms that need no announcement)
        d, c = self.digits, self.letters
        return self.r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{c(2)} {d(2)} {d(2)} {d(2)} {c(1)}", f"{d(8)}-{c(1)}", f"{d(8)}{c(1)}", f"{c(1)}-{d(7)}-{c(1)}", f"{c(1)}{d(7)}{c(1)}", f"{c(2)}{d(6)}{c(1)}"])

    def i(self) -> str:
        d, c = self.digits, self.letters
        return self.I() if self.r.random() < 0.6 else self.r.choice([*[f"{d(3)} {d(2)} {d(4)}"] * 3, f"{d(9)}", f"{c(1)}{d(8)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(11)}", f"{c(2)}{d(7)}", f"{d(6)}-{d(4)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{c(3)}{d(6)}", f"{c(1)}{d(2)}{c(2)}{d(4)}"])

    def a(self) -> str:
        r, w = self.r, lambda: self.capital()
        n = str(r.randint(1, 999 if r.random() < 0.2 else 250)) + r.choice(["", "", "", "", "a", "b", "c"])
        name, t = r.choice([w(), w(), self.syllables().capitalize() + r.choice("field wood moor marsh brook ton".split()), f"{w()} {w()}"]), r.choice(STREET_EN)
        place, d, c = self.surname, self.digits, self.letters
        town = r.choice(["", "", "", f", {place()}", f", {place()} {w()}", f", {place()} {c(2)}{d(1)} {d(1)}{c(2)}", f", {c(2)}{d(2)} {d(1)}{c(2)}", f", {place()}, {c(2)} {d(5)}"])
        mainland = r.choice(["", "", f", {d(5)} {place()}", f" in {place()}"])
        v = r.choice([
            f"{n} {name} {t}{town}", f"{n} {name} {t}{town}", f"{n} {name} {t}{town}", f"{n} {name} {t}, {r.choice(['Apt', 'Unit', 'Flat', 'Suite'])} {r.randint(1, 60)}{town}", f"{r.choice(['Flat', 'Apartment', 'Unit'])} {r.randint(1, 40)}, {n} {name} {t}{town}",
            f"{self.syllables().capitalize()}{r.choice(STREET_DE)} {n}{mainland}", f"{name} {r.choice(['Straße', 'Allee', 'Weg', 'Platz'])} {n}{mainland}", f"{self.syllables().capitalize()}{r.choice(STREET_DE)} {n}{mainland}", f"{r.choice(['Am', 'An der', 'Zum', 'Im'])} {self.syllables().capitalize()}{r.choice(STREET_DE)} {n}",
            f"{r.choice(STREET_ROMANCE)} {name} {n}{mainland}", f"{r.choice(STREET_ROMANCE)} {r.choice(['de', 'del', 'de la', 'da', 'di'])} {name} {n}, {r.randint(1, 8)}º{r.choice('ABCD')}", f"{r.choice(STREET_ROMANCE)} {name} {n}, {r.randint(1, 8)}º{r.choice('ABCD')}", f"{n} {r.choice(['rue', 'avenue', 'place', 'bd'])} {r.choice(['', 'de ', 'du ', 'des '])}{name}{mainland}", f"{self.syllables().capitalize()}{r.choice(['straat', 'laan', 'weg', 'gatan', 'vej'])} {n}{mainland}",
        ])
        return r.choice([v, v, v, v, v.lower()])

    def num(self) -> str:
        r, d, c = self.r, self.digits, self.letters
        return r.choice([
            d(1), d(2), d(3), d(4), d(5), d(6), d(7), d(8), d(9), d(10), d(11), d(12), d(14), f"{d(2)}.{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(3)}.{d(3)}.{d(1)}.{d(2)}", f"97{r.choice('89')}-{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{d(3)}-{d(2)}-{d(1)}", f"{d(3)}-{d(4)}",
            f"{d(1)},{d(3)}", f"${d(2)}.{d(2)}", f"{c(2)}{d(4)}", f"{c(3)}-{d(4)}", f"{c(1)}{d(2)}", f"v{d(1)}.{d(1)}", f"{d(4)}x{d(4)}", f"0x{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{c(2)}-{d(3)}-{d(4)}", self.date(), self.time(), f"#{d(4)}", f"{d(3)}-{c(2)}-{d(3)}", f"1{d(9)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}",
        ])

    def date(self) -> str:
        r = self.r
        return r.choice([f"20{self.digits(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{self.digits(2)}", f"{r.randint(1, 12):02}/{r.randint(1, 28):02}/{self.digits(2)}"]) + r.choice(["", " " + self.time()])

    def time(self) -> str:
        return f"{self.r.randint(0, 23):02}:{self.r.randint(0, 59):02}"

    def value(self, slot: str) -> str:
        r = self.r
        if slot in PRIVATE or slot in ("num", "date", "time"):
            return getattr(self, slot)()
        if slot in _CUE_SLOTS:
            v = r.choice(CUES[_CUE_SLOTS[slot]])
            return r.choice([v, v, v, v.capitalize(), v.upper() if len(v) < 5 else v])
        if slot in LINKS:
            return r.choice(LINKS[slot])
        if slot[0] == "d" and slot[1:].isdigit():
            return r.choice("123456789") + self.digits(int(slot[1:]) - 1)
        if slot == "st":
            return r.choice(STREET_EN)
        if slot == "and":
            return r.choice(["and", "und", "y", "et", "or", "&"])
        return {"w": self.word, "X": lambda: self.syllables().capitalize(), "C": self.capital, "G": self.given}[slot]()


PRIVATE = {"N": "person_name", "e": "email", "p": "phone", "i": "id_number", "I": "id_number", "a": "address", "n": "person_name", "l": "person_name"}
_CUE_SLOTS = {"ce": "email", "cp": "phone", "ci": "id_number", "ca": "address", "cn": "person_name", "cx": "other"}


def rows(words: list[str], names: list[str], each: int = 20, seed: int = 11) -> list[tuple[bool, str, list[tuple[int, int, str]]]]:
    """(whether it is an author's name, text, spans with their types)."""
    m = Maker(seed, words, names)
    r = m.r
    out: list[tuple[bool, str, list[tuple[int, int, str]]]] = []

    def make(frame: str, author: bool = False) -> None:
        text, spans = "", []
        if not author and r.random() < 0.4:
            text = " ".join(m.capital() if r.random() < 0.15 else m.word() for _ in range(r.randint(1, 5))) + r.choice([" ", " ", ". ", "! ", ": ", ", ", "; ", " - "])
        if not author and r.random() < 0.4:
            frame += r.choice([" ", " ", ". ", ", ", "! ", " and ", "? "]) + " ".join(["{w}"] * r.randint(1, 4)) + r.choice(["", ".", "!", "?"])
        elif r.random() < 0.2:
            frame += r.choice([".", "!", ",", ";"])
        for part in re.split(r"(\{\w+\})", frame.replace("} ,", "},")):
            if part[:1] != "{":
                text += part
                continue
            v = m.value(part[1:-1])
            if part[1:-1] in PRIVATE:
                spans.append((len(text), len(text) + len(v), PRIVATE[part[1:-1]]))
            text += v
        if r.random() < 0.06:
            t = text.upper() if r.random() < 0.5 else text.lower()
            text = t if len(t) == len(text) else text
        elif r.random() < 0.3:
            text = text[:1].upper() + text[1:]
        out.append((author, text, spans))

    for frames in (FRAMES, NEITHER):
        for frame in frames.replace("\n", "|").split("|"):
            for _ in range(each):
                make(frame)
    for _ in range(each * 90):  # capitals and signs anywhere, as in languages that write nouns with a capital
        dense = r.choice((0.1, 0.3, 0.5, 0.7))
        parts = [r.choice(["{X}", "{X}", "{C}"]) if r.random() < dense else "{w}" for _ in range(r.randint(2, 8))]
        for k in range(len(parts)):
            if r.random() < 0.2:
                parts[k] += r.choice([",", ",", ".", ".", ".", "!", ":", ";", " und", " and", " de"])
            elif r.random() < 0.1 and k + 2 < len(parts):
                parts[k], parts[k + 2] = "(" + parts[k], parts[k + 2] + ")"
        make(" ".join(parts))
    for frame in (AUTHORS + "|" + HANDLES).split("|"):
        for _ in range(2 * each):
            make(frame, True)
    return out
