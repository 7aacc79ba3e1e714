"""Trains the model for personal information: ``python -m stratalode.llm.pii_train``.

Texts are generated from invented names, numbers and streets in several
national forms, mixed with prose, code, headings and the numbers and titles that
look alike.  Half of the people are outside the directory the features see.
"""

from __future__ import annotations

import random
import string
from pathlib import Path

from .crf import SemiMarkov
from .pii import People, candidates

SAMPLES, SEED = 12_000, 5
_SYL_G = "ar bel ca do el fi gra ha in jo ka li mo na o pe ri sa te u vi wen ya zo".split()
_SYL_F = "bran cor dun esk far gol hart ing kel lor mar nor ost pen quar ros stan tor ul var wick yar zel".split()
NOUN = "marker cursor ledger shard retry budget tenant packet route member witness index queue batch scope symbol layer window table field page token posting trigger road map street plan".split()
VERB = "scan pack merge split fold load trace rank drain flush bind sample".split()
ADJ = "stale frozen sparse dense nightly local remote exact ordered lazy".split()
CITY = ["Ashford", "Port Linden", "Elmsby on Sea", "Stonebrook Mills", "Northmoor", "Dunwick", "Saint-Aubray", "Villaclara", "Grünfeld", "Bad Lorch", "Westhaven", "Kingsmere"]
STREET = ["Oak", "Harbour", "Mill Race", "Foundry", "Larkspur", "Queen", "Station", "Old Quarry", "Copper", "Meadow", "Heron", "Saltmarsh", "High"]
FR = ["de la Gare", "de la Fontaine", "du Moulin", "des Lilas", "de la Grande Écluse", "Victor Aubin"]
ES = ["de la Rosa", "del Molino", "Mayor", "de la Noria", "San Telmo"]


class Gen:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        mk = lambda syl, n, end: sorted({"".join(self.r.choice(syl) for _ in range(self.r.randint(2, 3))).capitalize() + self.r.choice(end) for _ in range(n)})
        self.given = mk(_SYL_G, 90, ["", "", "n", "s", "é", "ö", "a"])
        self.family = mk(_SYL_F, 110, ["", "son", "berg", "well", "ez", "ström", "ley"])
        self.r.shuffle(self.given)
        self.r.shuffle(self.family)
        self.people = People([(g, f) for g, f in zip(self.given[:45], self.family[:45])])

    def pick(self, x):
        return self.r.choice(x)

    def digits(self, shape):
        return "".join(self.r.choice("123456789") if c == "N" else self.r.choice(string.digits) if c == "0" else self.r.choice("ABCDEFGHLMPRT") if c == "A" else c for c in shape)

    def fam(self):
        f = self.pick(self.family)
        r = self.r.random()
        return f + "-" + self.pick(self.family) if r < 0.08 else self.pick(["d'", "O'"]) + f if r < 0.16 else self.pick(["van ", "de ", "von "]) + f if r < 0.18 else f

    def name(self):
        g, f = self.pick(self.given), self.fam()
        r = self.r.random()
        gap = self.pick([" ", " ", " ", " ", " ", "\n"])
        if r < 0.62:
            s = g + gap + f
        elif r < 0.78:
            s = f + "," + self.pick([" ", " ", "\n"]) + g
        elif r < 0.90:
            s = f"{g} {self.pick(string.ascii_uppercase[:18])}.{gap}{f}"
        else:
            s = f + gap + g
        r = self.r.random()
        if r < 0.12:
            return s.upper()
        if r < 0.18:
            known_g, known_f = self.pick(self.given[:45]), self.pick(self.family[:45])
            return (known_g + gap + known_f).lower()
        return s

    def email(self):
        g, f = self.pick(self.given).lower(), self.pick(self.family).lower()
        local = self.pick([f"{g}.{f}", f"{g[0]}{f}", f"{g}", f"{g}_{f}", f"{g[0]}.{f}"]) + self.pick(["", "", str(self.r.randint(1, 99)), "+" + self.pick(NOUN)])
        domain = self.pick(["example.org", "mail.example.com", "lists.example.net", "post.invalid", "northmoor.example", "uni.example.co.uk"])
        r = self.r.random()
        if r < 0.14:
            return f"{local} [at] {domain.replace('.', ' [dot] ')}"
        if r < 0.28:
            return f"{local}(at){domain}"
        s = f"{local}@{domain}"
        return s[0].upper() + s[1:].split("@")[0] + "@" + domain.upper() if r < 0.36 else s

    def phone(self):
        return self.digits(self.pick(["+44 20 7946 0000", "+N N00-555-0000", "(N00) 555-0000", "N00.555.0000", "01 99 00 00 00", "+33 1 99 00 00 00", "+49 (0)30 23125 000", "+34 600 000 000", "020 7946 0000", "N00-555-0000", "+1 (N00) 555-0000", "0N0 00000000", "0044 20 7946 0000", "+49 30 0000000", "+81 3-0000-0000", "01632 960000"]))

    def id(self):
        return self.digits(self.pick(["N00-00-0000", "N00-00-0000", "1 00 00 00 000 000 00", "2 00 00 00 000 000 00", "A00000000", "A00000000", "00000000A", "AA 00 00 00 A", "AA000000A", "A0000000A", "00 000000 A 000"]))

    def address(self):
        n, c = self.r.randint(1, 299), self.pick(CITY)
        return self.pick([
            lambda: f"{n} {self.pick(STREET)} {self.pick(['Street', 'Road', 'Ave', 'Ln', 'Drive', 'Lane', 'Avenue', 'Close', 'Court', 'Way'])}, {c}",
            lambda: f"{n} {self.pick(STREET)} St., Apt {self.r.randint(1, 40)}, {c} {self.digits('N0000')}",
            lambda: f"Flat {self.r.randint(1, 60)}, {n} {self.pick(STREET)} {self.pick(['Close', 'Road', 'Street'])}, {c}",
            lambda: f"{n} rue {self.pick(FR)}, {self.digits('N0000')} {c}",
            lambda: f"Calle {self.pick(ES)} {n}, {self.digits('N0000')} {c}",
            lambda: f"{self.pick(STREET).replace(' ', '')}{self.pick(['straße', 'strasse', 'weg'])} {n}, {self.digits('N0000')} {c}",
            lambda: f"{n} {self.pick(STREET)} Street",
        ])()

    def prose(self):
        n = lambda: self.pick(NOUN)
        a, v = self.pick(ADJ), self.pick(VERB)
        return self.pick([
            f"The {a} {n()} keeps one {n()} per {n()}.", f"Decision: {v} every {n()} at the {n()} border.", f"Nobody owns the {n()} yet, so the {n()} stays {a}.",
            f"Since build {self.r.randint(1, 999)} the {n()} can {v} without its {n()}.", f"See {n()}/{n()}/{v}_{n()}.py for the {a} path.", f"`{v.capitalize()}{n().capitalize()}` replaces the old {n()} and its {n()}.",
            f"Please {v} the {n()} first; the {n()} can wait.", f"We measured {self.r.randint(1, 999)} ms for a {a} {n()} with {self.r.randint(2, 40)} {n()}s.", f"The {n()} count went from {self.r.randint(1, 999)} to {self.r.randint(1, 999)} after the {n()} change.",
            f"# {n().capitalize()} {n()} in north-gate", f"## {a.capitalize()} {n()}s", f"{v.capitalize()} {n().capitalize()} is {a}", f"- If the {n()} is {a}, {v} it again.", f"Bitte den {n()} vor dem {n()} schließen.", f"Le {n()} reste {a} tant que le {n()} manque.", f"Call `{v}_{n()}` before you {v} the {n()}.",
            f"Line {self.r.randint(1, 900)} binds {n()} to {n()}; {v} {n()} then drops {a} {n()} copies.", f"Expected evidence: {n()} {n()} handing {n()} to {v} {n()}.", f"The {n().capitalize()} {self.pick(['Road Map', 'Street Plan', 'Court', 'Review', 'Guide'])} is {a}.", f"Unlike the {n()}, a {n()} holds no {n()}.",
        ])

    def loud(self):
        """Prose in other cases: capitals throughout, or every word capitalised."""
        s = " ".join(self.prose() for _ in range(self.r.randint(1, 3)))
        return s.upper() if self.r.random() < 0.75 else s.title()

    def trap(self):
        r, d = self.r, self.digits
        n = lambda: self.pick(NOUN)
        v = self.pick(VERB)
        return self.pick([
            f"bytes {r.randint(100, 999)}-{r.randint(1000, 9999)}, page {r.randint(1, 99)}", f"10.{r.randint(1, 99)}.{r.randint(1, 99)}.{r.randint(1, 99)}:8080", f"doi 10.{d('0000')}/{d('00000.000')}", f"2025-03-{r.randint(10, 28)} 10:{d('00')}:{d('00')}", f"build {d('20250000-0000-0000')}", f"npm i {n()}lib@{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"run id {d('N00000000000')}", f"error {d('N00-000')} in {v.capitalize()}{n().capitalize()}", f"git@code.{self.pick(['example.org', 'mail.example.com', 'post.invalid'])}:{n()}/{n()}.git", f"@{n()}.{v} is a decorator", f"line {r.randint(1, 99)} {n().capitalize()} Road map", f"line {r.randint(1, 99)} {n().capitalize()} Street plan",
            f"commit {''.join(r.choice('0123456789abcdef') for _ in range(40))}", f"Hi {self.pick(self.given)} {self.pick(string.ascii_uppercase)}.,", f"Hi {self.pick(self.given)},", f"I spoke with {self.pick(self.given)} about the {n()}.", f"{self.pick(self.family)} since the {n()} {v}", f"@cached(maxsize={r.randint(1, 400)})", f"version {r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}-rc.{r.randint(1, 9)}", f"{d('N00')} {n().capitalize()} rows in {r.randint(1, 99)} {n()}s", f"port {d('N0000')} on {n()}-{d('00')}", f"order {d('N0000000')} shipped", f"serial {d('N00000000')}", f"{self.pick(self.given)}'s {n()} is {self.pick(ADJ)}", f"tag v{d('N.N.N')}", f"sha {d('00000000')}", f"{d('N0000-0000')} {n()}s", f"ratio {d('0.000000')}", f"The {self.pick(self.family)} {n()} is {self.pick(ADJ)}.", f"{self.pick(ADJ).capitalize()} {n().capitalize()}, {n().capitalize()} and {n().capitalize()}", f"export class {v.capitalize()}{n().capitalize()} {{", f"import {{ {v}{n().capitalize()} }} from './{n()}';", f"Thanks to the {n().capitalize()} {self.pick(['Team', 'Group'])} for the fix.", f"On Monday {n()} {v}s.", f"epoch {d('1700000000')}", f"{d('00:00:00')} {n()} {v}", f"Owner: {n().capitalize()} Team", f"Owner: {self.pick(self.given)}",
        ])

    def item(self):
        n = self.pick(NOUN)
        r = self.r.random()
        w = lambda s: "«" + s + "»"
        if r < 0.34:
            s = w("name:" + self.name())
            e = w("email:" + self.email())
            return self.pick([f"Hi {s},", f"Dear {s},", f"Owner: {s}", f"Owner: {s}", f"Owner: {s}", f"Maintainer: {s}", f"Lead: {s}", f"Signed-off-by: {s} <{e}>", f"Reviewed-by: {s} <{e}>", f"I spoke with {s} about the {n}.", f"Thanks to {s} for the {n} fix.", f"assigned to {s} since the {n} split", s, f"cc {s}", f"{s} wrote:", f"Author: {s}", f"{s} reported that the {n} is stale.", f"Please ask {s} first.", f"Regards,\n{s}", f"- {s} ({self.pick(ADJ)})", f"@reviewers: {s}, {w('name:' + self.name())}", f"decided by {s} on Monday"])
        if r < 0.54:
            e = w("email:" + self.email())
            return self.pick([f"Reply-To: {e}", f"Ask {e} about the {n}.", f"Logs go to <{e}> every night.", f"contact={e};role={n}", f"mail {e}", f"mailto:{e}", f"({e})", f"{e}", f"From: {e}"])
        if r < 0.70:
            p = w("phone:" + self.phone())
            return self.pick([f"Phone: {p}", f"On call this week: {p} (evenings).", f"ring {p} if the {n} stalls", f"tel {p}, ask for the {n} desk", f"Tel. {p}", f"call {p}", f"Mobile {p}", f"WhatsApp {p}", f"Fax: {p}"])
        if r < 0.84:
            i = w("id_number:" + self.id())
            return self.pick([f"The badge form still shows identity number {i}.", f"SSN/ID {i} was pasted into the ticket", f"national id: {i}", f"passport or id card no. {i} (remove!)", f"SSN: {i}", f"DNI {i}", f"tax id {i} in the log", f"insurance number {i}"])
        a = w("address:" + self.address())
        return self.pick([f"Ship the test rack to {a}.", f"Address: {a}", f"the meeting is at {a} on Monday", f"office: {a}", f"{a}", f"send it to {a}, please", f"We moved to {a}."])

    def text(self):
        parts, gaps = [], []
        for _ in range(self.r.randint(2, 7)):
            r = self.r.random()
            parts.append(self.item() if r < 0.34 else self.trap() if r < 0.6 else self.prose() if r < 0.9 else self.loud())
            gaps.append(self.pick([" ", "\n", "\n\n", "\n\n"]))
        raw = "".join(p + g for p, g in zip(parts, gaps))
        plain, spans, start = "", set(), 0
        i = 0
        while i < len(raw):
            c = raw[i]
            if c == "«":
                j = raw.index(":", i)
                kind, start = raw[i + 1 : j], len(plain)
                i = j + 1
                continue
            if c == "»":
                spans.add((start, len(plain), kind))
            else:
                plain += c
            i += 1
        return plain, spans


def example(text, spans, people):
    return candidates(text, people), spans, text


def train(samples: int = SAMPLES, seed: int = SEED) -> SemiMarkov:
    model, data = SemiMarkov(), []
    for k in range(8):  # several worlds of names, so that no weight leans on one
        g = Gen(seed + k)
        data += [example(*g.text(), g.people) for _ in range(samples // 8)]
    model.train(data, rounds=5)
    return model


def accuracy(model: SemiMarkov, samples: int = 1500, seed: int = 1234) -> dict[str, tuple[float, float]]:
    """Precision and recall of (start, kind) per kind on held-out texts of another world."""
    g = Gen(seed)
    counts: dict[str, list[int]] = {}
    for _ in range(samples):
        text, spans = g.text()
        got = {(a, k) for a, _, k, _ in model.decode(candidates(text, g.people), text)}
        want = {(a, k) for a, _, k in spans}
        for k in {k for _, k in got | want}:
            c = counts.setdefault(k, [0, 0, 0])
            a, b = {x for x in got if x[1] == k}, {x for x in want if x[1] == k}
            c[0] += len(a & b)
            c[1] += len(a - b)
            c[2] += len(b - a)
    return {k: (round(tp / max(1, tp + fp), 4), round(tp / max(1, tp + fn), 4)) for k, (tp, fp, fn) in sorted(counts.items())}


if __name__ == "__main__":
    m = train()
    m.save(Path(__file__).with_name("pii_model.json"))
    print("held-out precision and recall:", accuracy(m))
