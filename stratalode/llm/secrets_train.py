"""Trains the credential model: ``python -m stratalode.llm.secrets_train``.

No labelled rows exist, so lines are generated: assignments, calls, headers,
URLs, comments, configuration and key blocks with invented credentials, and the
same places filled with references, placeholders, checksums, identifiers, code.
``«`` and ``»`` in a template enclose what is secret.
"""

from __future__ import annotations

import base64
import random
import string
from pathlib import Path

from .crf import LinearChain
from .secrets import features, tokens

SAMPLES, SEED = 40_000, 11

ALNUM = string.ascii_letters + string.digits
NOUNS = "amber anchor basin beacon cedar comet delta ember fable garnet harbor island jasper kettle lagoon meadow nectar orchid pebble quartz river saffron timber umber velvet willow yarrow zenith route batch ledger cursor shard page tenant mailbox scope window policy token session index".split()
ADJ = "quiet bright local sparse dense frozen remote stale eager lazy ordered wide".split()
KEYS = [("db", "password"), ("api", "key"), ("client", "secret"), ("auth", "token"), ("access", "token"), ("smtp", "pass"), ("service", "pwd"), ("webhook", "secret"), ("signing", "key"), ("private", "token"), ("deploy", "credential"), ("registry", "password"), ("admin", "passwd"), ("session", "secret"), ("api", "token"), ("private", "key"), ("root", "password"), ("encryption", "key"), ("bot", "token"), ("storage", "account", "key")]
SHORT = ["password", "passwd", "pwd", "secret", "token", "pass"]
NEG_TAIL = ["label", "hint", "field", "file", "ref", "kind", "pattern", "name", "path", "url", "id"]


class Gen:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, xs):
        return self.r.choice(xs)

    def chars(self, n, pool=ALNUM):
        return "".join(self.r.choice(pool) for _ in range(n))

    def noun(self):
        return self.pick(NOUNS)

    # secrets
    def b64(self, n):
        return base64.b64encode(bytes(self.r.randrange(256) for _ in range(n))).decode()

    def prefixed(self):
        return self.pick([lambda: self.pick(["ghp_", "gho_", "ghs_", "ghu_", "ghr_"]) + self.chars(36), lambda: "sk-" + self.chars(self.r.randint(32, 48)), lambda: self.pick(["tdw", "emb", "lnt", "pay", "acme", "sb"]) + "_live_" + self.chars(28), lambda: "AKIA" + self.chars(16, string.ascii_uppercase + string.digits), lambda: self.pick(["xoxb-", "glpat-", "npm_", "pk_test_", "hf_"]) + self.chars(self.r.randint(20, 36))])()

    def phrase(self):
        return self.noun().capitalize() + self.pick("#!._-@~") + self.pick(ADJ) + str(self.r.randint(10, 9999)) + self.pick(["&", "!", "%", "?", "*", "=", "#", ""])

    def jwt(self):
        return ".".join(["eyJ" + self.chars(30), "eyJ" + self.chars(52), self.chars(43, ALNUM + "_-")])

    def secret(self):
        return self.pick([self.prefixed, self.prefixed, self.phrase, self.phrase, self.jwt, lambda: self.b64(32), lambda: self.chars(self.r.randint(16, 40)), lambda: self.chars(32, "0123456789abcdef"), lambda: self.chars(self.r.choice([32, 40, 64]), "0123456789abcdef"), lambda: self.noun() + self.chars(6) + self.pick(["", "!"]), lambda: self.b64(self.r.randint(18, 60))])()

    # names
    def style(self, words):
        s = self.r.randrange(5)
        if s == 0:
            return "_".join(words)
        if s == 1:
            return words[0] + "".join(w.capitalize() for w in words[1:])
        if s == 2:
            return "_".join(words).upper()
        if s == 3:
            return "".join(w.capitalize() for w in words)
        return self.pick(["-", "."]).join(words)

    def key(self):
        words = list(self.pick(KEYS)) if self.r.random() < 0.75 else [self.pick(SHORT)]
        if self.r.random() < 0.15:
            words.append(self.pick(["ci", "dev", "prod", "staging", self.noun()]))
        if self.r.random() < 0.1:
            words.insert(0, self.noun())
        return self.style(words)

    def other(self):
        return self.style([self.pick(["read", "load", "merge", "split", "pack", "scan", "max", "min", "old"]), self.noun()])

    def neutral_value(self):
        r = self.r
        return self.pick(
            [self.noun, lambda: f"{self.noun()}-{self.noun()}", lambda: f"{self.noun()}/{self.noun()}_{self.noun()}.py", lambda: str(r.randint(0, 99999)), lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{self.noun()} {self.noun()}", self.other, lambda: self.other() + str(r.randint(0, 99)), lambda: f"{r.randint(10, 250)}ms", lambda: f"v{r.randint(1, 9)}", lambda: f"utf-8", lambda: f"{self.noun()}_{r.randint(0, 999)}", lambda: "%Y-%m-%dT%H:%M:%S", lambda: f"{self.noun()}.{self.noun()}.example", lambda: f"{self.noun()}:{r.randint(1000, 9999)}"]
        )()

    def hole(self, key):
        k = key.lower()
        return self.pick(["changeme", "change-me", "xxxxxxxxxxxxxxxxxxxx", "********", "<your-" + k.replace("_", "-") + ">", "<" + key + ">", "your-" + k.replace("_", "-") + "-here", "${" + key.upper() + "}", "REDACTED", "TODO", "", "example", "{{ " + key + " }}", "$" + key.upper(), "%(" + key + ")s", "dummy", "#" * 8, "****" + self.chars(4), "placeholder"])

    def public_value(self):
        return self.pick([lambda: self.chars(40, "0123456789abcdef"), lambda: self.chars(64, "0123456789abcdef"), lambda: "sha512-" + self.b64(64), lambda: "sha256-" + self.b64(32), lambda: "-".join(self.chars(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12)), lambda: self.chars(12, "0123456789abcdef"), lambda: self.chars(16, "0123456789abcdef"), lambda: self.chars(32, "0123456789abcdef"), lambda: "sha256:" + self.chars(64, "0123456789abcdef")])()

    def public_key(self):
        return self.pick(["REVISION", "CHECKSUM_" + self.noun().upper(), self.noun() + "Revision", self.noun() + "Integrity", "integrity", "checksum", "revision", self.noun() + "Id", self.noun() + ".sum", "commit", "DESCRIPTOR", "etag", self.noun() + "_digest", "sha256", "PINNED_REVISION", "fingerprint", "build_id", "content_hash", "request_id"])

    def assign(self, k, v):
        q = self.pick("\"'")
        ext = self.pick(["", ",", ";"])
        return self.pick(
            [f"{k} = {q}{v}{q}", f"const {k} = {q}{v}{q};", f"export const {k} = {q}{v}{q};", f"let {k} = {q}{v}{q};", f"var {k} = {q}{v}{q}", f"const {k} = `{v}`;", f"  {q}{k}{q}: {q}{v}{q},", f"    {k}: {q}{v}{q},", f"{k} = {q}{v}{q}  # {self.noun()}", f"self.{k} = {q}{v}{q}", f"{k}: str = {q}{v}{q}", f"var {k} = []byte(`{v}`)", f"\t{k} := \"{v}\"", f"{{ user: 'svc', {k}: {q}{v}{q} }}{ext}", f"connect(host, {k}={q}{v}{q})", f"return Client('{self.noun()}.example', user='svc', {k}={q}{v}{q})", f"process.env.{k} ??= {q}{v}{q};", f"os.Setenv(\"{k}\", \"{v}\")", f"os.environ.setdefault({q}{k}{q}, {q}{v}{q})", f"{k} = ({q}{v}{q})", f"setattr(config, {q}{k}{q}, {q}{v}{q})", f"if {k} == {q}{v}{q}:", f"private static final String {k} = \"{v}\";"]
        )

    def bare(self, k, v):
        return self.pick([f"{k}={v}", f"export {k}={v}", f"{k}: {v}", f"{k} = {v}", f"{self.noun()}-{self.noun()}.{k}={v}", f"  {k}: {v}", f"Run it with `--{k} {v}` until the new key arrives.", f"$ tool --{k}={v}", f"| {k} | {v} |"])

    def positive(self):
        r = self.r.random()
        s = "«" + self.secret() + "»"
        if r < 0.36:
            return self.assign(self.key(), s), 0, False
        if r < 0.46:
            return self.bare(self.key(), s), 0, True
        if r < 0.53:
            a = f"{self.pick(['postgres', 'mysql', 'redis', 'amqp', 'https', 'mongodb', 'ftp'])}://{self.pick(['svc_', '', 'u_'])}{self.noun()}:«{self.pick([self.phrase, lambda: self.noun() + self.pick('-._~') + self.chars(self.r.randint(6, 9)), lambda: self.chars(12)])().replace('@', '-').replace('#', '-').replace('?', '')}»@{self.noun()}.{self.noun()}.example:{self.r.randint(1000, 9999)}/{self.noun()}-{self.noun()}"
            n = self.other()
            return self.pick([f'return connect("{a}")', f"export const {n}Pool = create(`{a}`);", f"{n}_dsn: {a}", f'  "{n}Url": "{a}",', f"{n.upper()}_URL={a}", f'return "{a}"', f"git clone {a}", f"# see {a}"]), 0, self.r.random() < 0.3
        if r < 0.64:
            v = "«" + self.pick([self.prefixed, self.jwt, lambda: self.chars(40)])() + "»"
            return self.pick([f"headers: {{ Authorization: 'Bearer {v}' }},", f"session.headers['Authorization'] = 'Bearer {v}'", f'r.Header.Set("Authorization", "Bearer {v}")', f"curl -H 'Authorization: Bearer {v}' https://{self.noun()}.example/", f"Authorization: Bearer {v}", f"-H \"X-Api-Key: {v}\" \\"]), 0, False
        if r < 0.71:
            v = "«" + base64.b64encode(f"svc_{self.noun()}:{self.phrase()}".encode()).decode() + "»"
            n = self.other()
            return self.pick([f'const {n}Auth = "Basic {v}";', f"HEADERS = {{'Authorization': 'Basic {v}'}}", f'var {n}Header = "Basic {v}"', f"headers: {{ Authorization: 'Basic {v}' }},"]), 0, False
        if r < 0.79:
            v = "«" + self.prefixed() + "»"
            k = self.pick(KEYS)
            return self.pick([f"# old key, still accepted by staging: {v}", f"/* remove before release: {v} */", f"// previous {'_'.join(k)} {v} (revoke after rollout)", f"// {'_'.join(k)}: {v}", f" * use {v} for now", f"# TODO rotate {v}", f"-- {self.noun()} {'_'.join(k)} «{self.secret()}»", f"<!-- {v} -->"]), 0, False
        if r < 0.86:
            s = self.pick([self.prefixed, lambda: self.chars(24), lambda: self.b64(24).rstrip("=")])()
            c = self.r.randint(3, len(s) - 6)
            k = self.key()
            return self.pick([f'{k} = "«{s[:c]}»" + "«{s[c:]}»"', f"const {k} = ['«{s[:c]}»', '«{s[c:]}»'].join('');", f"const {k} = '«{s[:c]}»' + '«{s[c:]}»';", f'{k} = "«{s[:c]}»" "«{s[c:]}»"', f'var {k} = strings.Join([]string{{"«{s[:c]}»", "«{s[c:]}»"}}, "")', f"{k} := \"«{s[:c]}»\" + \"«{s[c:]}»\""]), 0, False
        kind = self.pick(["RSA ", "EC ", "", "OPENSSH ", "ENCRYPTED ", "DSA "])
        mark = f"-----BEGIN {kind}PRIVATE KEY-----"
        n, k = self.other(), self.key()
        body = self.b64(48)
        return self.pick([f"«{mark}»", f"const {n}PEM = `«{mark}»", f'const {n}Pem = "«{mark}»\\n«{body}»\\n«{self.b64(48)}»\\n-----END {kind}PRIVATE KEY-----\\n";', f'  "{k}": "«{mark}»\\n«{body}»\\n-----END {kind}PRIVATE KEY-----",', f'KEY = """«{mark}»', f"  «{mark}»"]), 0, False

    def negative(self):
        r = self.r.random()
        if r < 0.14:
            k = self.key()
            return (self.assign if self.r.random() < 0.7 else self.bare)(k, self.hole(k)), 0, self.r.random() < 0.3
        if r < 0.24:
            k = self.style([*self.pick(KEYS), self.pick(NEG_TAIL)])
            return (self.assign if self.r.random() < 0.7 else self.bare)(k, self.pick([lambda: "password", lambda: f"/run/secrets/{'_'.join(self.pick(KEYS))}", self.noun, lambda: "********", lambda: "xxxxxxxxxxxx", lambda: f"^sk-[A-Za-z0-9_-]{{20,}}$", lambda: "${" + k.upper() + "}", lambda: "Enter your password", lambda: self.noun() + "Token"])()), 0, self.r.random() < 0.3
        if r < 0.33:
            k = self.key()
            up = k.upper().replace("-", "_").replace(".", "_")
            return self.pick([f'{up} = os.environ["{up}"]', f'var {k} = os.Getenv("{up}")', f"const {k} = process.env.{up};", f"{k}: ${{{up}}}", f"{k}=${{{up}}}", f"{k} = getpass.getpass('{k}: ')", f"{k} = config.get('{k}')", f"const {k} = await vault.read('{self.noun()}/{k}');", f'{up} = ""  # filled by the deploy job', f'  "{k}Ref": "${{{up}}}",', f"return fetch_{k}(self.{self.noun()}, {self.r.randint(1, 500)})", f"{k}_file = \"/run/secrets/{k}\"", f"token = {self.other()}({self.noun()}, limit={self.r.randint(1, 400)})", f"def {self.other()}(token, secret=None):", f"if not token: raise TokenError(f'no {{token}} for {{{self.noun()}}}')", f"const url = `https://${{user}}:${{password}}@host.invalid/`;", f'dsn = "postgres://${{USER}}:${{PASSWORD}}@localhost/dev"', f'dsn = f"postgres://{{user}}:{{password}}@{{host}}/db"', f"headers['Authorization'] = f'Bearer {{token}}'", f"Authorization: 'Bearer ' + {k},", f"-H \"Authorization: Bearer ${up}\""]), 0, False
        if r < 0.47:
            return (self.assign if self.r.random() < 0.75 else self.bare)(self.public_key(), self.public_value()), 0, self.r.random() < 0.3
        if r < 0.53:
            k = self.pick(["token", "secret", "page", "cursor", "key", "session"])
            return self.pick([f"'{self.other()}': ({self.r.randint(1, 99)}, '{self.pick(ADJ)} {k}'),", f'"{self.noun()}_{k}": {self.r.randint(1, 999)},', f"token_kind = '{self.noun()}'", f"{self.noun()}_token: {self.pick(ADJ)}", f"for (const token_ of tokens) {{", f"case '{k}':", f"const {self.other()}Pattern = /^sk-[A-Za-z0-9_-]{{20,}}$/;", 'return "PRIVATE KEY-----" in text or re.search(r"gh[pousr]_[A-Za-z0-9]{20,}", text)', f'out <- {self.noun()} + ":token"', f"assert result.token == {self.r.randint(1, 400)}", f"import {{ {self.other()} }} from './{self.noun()}/token';", f"expect(result.{self.noun()}).toEqual(\"it's token\");", f"token {self.noun()} from {self.noun()} where {self.noun()} > {self.r.randint(1, 600)}", f"export const {self.other()}Fetch = () => fetch('https://{self.noun()}.{self.noun()}-gate.example/v1', {{", f"def {self.other()}_token({self.noun()}s, limit={self.r.randint(1, 500)}):", f"# Größe des Token-Puffers, nicht des {self.noun().capitalize()}s", f"// {self.noun()} 与 token 的顺序保持不变", f"Garde le token à côté du {self.noun()}", f'return f"{self.noun()}:{{{self.noun()}_id.lower()}}:{{{self.other()}({self.noun()}_id)[:{self.r.randint(1, 9)}]}}"', f"const {self.other()}Skip = ['third_party/', '.min.js', '_pb2.py'];", f"export const {self.noun().upper()}_TOKEN: Record<string, number> = {{", f"l.token=[{self.r.randint(1, 999)},{self.r.randint(1, 999)}]}}({self.chars(2, string.ascii_lowercase)});var {self.chars(2, string.ascii_lowercase)}={{u:{self.r.randint(1, 999)},u:!1,t:\"{self.noun()}\"}};", f"{self.chars(2, string.ascii_lowercase)}.prototype.token=function({self.chars(1, string.ascii_lowercase)}){{for(var u0=0;u0<{self.r.randint(1, 999)};u0++)this.z+=p[u0]}};", f"WORDS = '{' '.join(self.noun() for _ in range(8))}'.split(' ')", f"from tokenlib import {self.other()}", f"# don't {self.noun()} twice: the token's {self.noun()} is {self.pick(ADJ)}", f"password_regex = re.compile(r'[A-Za-z0-9!#]{{8,}}')", f"return f\"token:{{token_id.lower()}}:{{{self.other()}(token_id)[:{self.r.randint(1, 9)}]}}\""]), 0, False
        if r < 0.63:
            kind = self.pick(["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST"])
            mark = f"-----BEGIN {kind}-----"
            n = self.other()
            return self.pick([mark, f'CERT = """{mark}', f"const {n}Pub = `{mark}", f'const {n}Cert = "{mark}\\n{self.b64(48)}\\n-----END {kind}-----\\n";', f"-----END {self.pick(['CERTIFICATE', 'RSA PRIVATE KEY', 'PRIVATE KEY'])}-----", f"ssh-ed25519 {self.b64(51)} {self.noun()}@{self.noun()}", f"ssh-rsa {self.b64(99)}"]), 0, False
        if r < 0.75:
            b = self.b64(self.r.choice([48, 57, 57]))
            return self.pick([b, f"'{b}'", f'    "{b}",', f"const {self.noun().upper()}_BLOB = '{b}{b}';", f"data:image/png;base64,{b}", f"const t=function({self.chars(2, string.ascii_lowercase)},e1){{return {self.chars(1, string.ascii_lowercase)}?v2[e1]:null}};", f'"{self.other()}_{self.r.randint(0, 99)}": [{self.r.randint(0, 99999)}, "{self.chars(16, "0123456789abcdef")}"],', f"DATA = '{b}'"]), 0, False
        return (self.assign if self.r.random() < 0.8 else self.bare)(self.other(), self.neutral_value()), 0, self.r.random() < 0.3

    def sample(self):
        """``line, secret spans, opened, config, block``."""
        r = self.r.random()
        opened, block = "none", ""
        if r < 0.06:
            block = "private"
            line, config = "«" + self.b64(self.r.choice([48, 48, 30, 12])) + "»", False
        elif r < 0.10:
            opened = "strong"
            line = self.pick(["  «" + self.secret() + "»", "    '«" + self.secret() + "»'", '  "«' + self.secret() + '»",', "«" + self.prefixed() + "»"])
            config = self.r.random() < 0.5
        elif r < 0.12:
            opened = self.pick(["strong", "strong-against", "soft"])
            n = self.noun()
            line = self.pick([f"continue", f"return await {n}.{self.noun()}({self.noun()})", f"self.{n} = {n}", f"'{self.other()}': ({self.r.randint(1, 99)}, '{self.pick(ADJ)} {n}'),", f"{self.other()}: {self.r.randint(1, 999)},", f'"{self.noun()}_{n}": {self.r.randint(1, 999)},', f"Keep the {n} {self.pick(ADJ)} until every {self.noun()} is known.", f"select {n}, {self.noun()} from {self.noun()} where {n} > {self.r.randint(1, 600)} and note <> '('", "-----BEGIN CERTIFICATE-----", f"  {self.other()}({self.r.randint(1, 400)}, `{n}`)", f"{self.hole('api_key')}", f"os.environ['{n.upper()}_TOKEN']"])
            config = self.r.random() < 0.3
        elif r < 0.14:
            opened = self.pick(["other", "against", "soft", "none"])
            line, config = self.pick(["", "  ", "'"]) + self.b64(48), False
        elif r < 0.5:
            line, _, config = self.positive()
        else:
            line, _, config = self.negative()
        line = self.pick(["", "", "  ", "\t", "    "]) + line
        spans, plain = [], ""
        for c in line:
            if c == "«":
                spans.append([len(plain), 0])
            elif c == "»":
                spans[-1][1] = len(plain)
            else:
                plain += c
        return plain, [tuple(s) for s in spans], opened, config, block


def example(sample):
    line, spans, opened, config, block = sample
    toks = tokens(line)
    feats, allowed = features(toks, line, opened, config, block, True)
    gold = [1 if allowed[i] and any(s < t[3] and t[2] < e for s, e in spans) else 0 for i, t in enumerate(toks)]
    return feats, gold, allowed


def train(samples: int = SAMPLES, seed: int = SEED) -> LinearChain:
    g = Gen(seed)
    model = LinearChain(["plain", "secret"])
    model.train([example(g.sample())[:2] for _ in range(samples)], rounds=4)
    return model


def accuracy(model: LinearChain, samples: int = 3000, seed: int = 99) -> tuple[float, float]:
    """Precision and recall of lines on held-out samples (another seed)."""
    g = Gen(seed)
    tp = fp = fn = 0
    for _ in range(samples):
        s = g.sample()
        feats, _, allowed = example(s)
        got, want = any(model.viterbi(feats, allowed)), bool(s[1])
        tp, fp, fn = tp + (got and want), fp + (got and not want), fn + (want and not got)
    return tp / max(1, tp + fp), tp / max(1, tp + fn)


if __name__ == "__main__":
    m = train()
    m.save(Path(__file__).with_name("secrets_model.json"))
    print("held-out precision and recall of lines:", accuracy(m))
