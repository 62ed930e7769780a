"""URL filters by a bit-parallel wildcard automaton (Shift-And over several machine words).

All glob rules are packed into one bit string, one bit per pattern character. For every URL the
set of active positions is a row of 64-bit words; one character moves all rules of all URLs of a
batch: shift, and with the mask of the character, or the loops of stars, then open the places
after stars. `*` is any run of characters, `?` any one character, `^` any run without a slash, `|` a border
of words: one of `.`, `-` and `/`.

The host rules of a list see the url as it is written. The method's own globs see its canonical form: the host
without user, port and last dots, the path with escapes decoded, A-Z lower-cased, `_`, `+` and blanks as `-`, and
a slash at its end. One automaton simulates all of them at once over a form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgspark.llm.scratch import lean

U = np.uint64


@dataclass(frozen=True)
class Rule:
    """verdict for URLs whose canonical form `.host + path` fits the glob; longest wins."""

    name: str
    glob: str
    verdict: str
    weight: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with all its subdomains, and what a path starts with."""
    return Rule(host + path, f"^.{host}{path}*", verdict, len(host) + len(path))


#: Fixed by the contract: (verdict, host, path).
CONTRACT = [host_rule("allow", "com", "/"), host_rule("block", "example.com", "/en/"), host_rule("allow", "www.example.com", "/en/"), host_rule("block", "net", "/es/"), host_rule("block", "net", "/fr/")]
#: The method's own rules decide where no host rule fits; else the verdict is allow. Fixed words of unwanted sites
#: (gambling, pills, adult, piracy, fraud, advertising), and of these the ones that no other word holds.
UNWANTED = (
    "casino poker roulette jackpot bets betting bookmaker slotmachine pills viagra cialis levitra xanax painkillers "
    "porn xxx hentai camgirl sexchat hookup warez keygen crackz serialz nulled payday counterfeit "
    "adult-x adult-video ads adserver adclick popunder clicktrack linkfarm sweepstakes"
).split()
ANYWHERE = "casino roulette jackpot bookmaker slotmachine viagra levitra xanax porn hentai camgirl sexchat keygen warez popunder clicktrack linkfarm".split()
#: Words of a host's name only, as pages about them are no harm.
IN_HOST = ("spam", "scam")
#: Public bodies and schools, whose pages are about such things and do not sell them.
PUBLIC = ("gov", "edu", "mil", "int")
#: A word between borders of host or path, also as a plural; a telling word anywhere in the host.
FORMS, HOST_FORMS, ANYWHERE_FORM = ("*|{}|*", "*|{}s|*"), ("^.{}|*", "^-{}|*"), "^{}*"


def default_rules(words=UNWANTED, anywhere=ANYWHERE, in_host=IN_HOST, public=PUBLIC) -> list[Rule]:
    """The first that fits decides, so what is allowed comes first: *.gov and, by country, *.gov.uk or *.ac.jp."""
    spared = [Rule(p, f"^.{p}/*", "allow", 0) for p in public] + [Rule(p, f"^.{p}.??/*", "allow", 0) for p in (*public, "ac")]
    return spared + [Rule(w, f.format(w), "block", 0) for of, forms in ((words, FORMS), (in_host, HOST_FORMS), (anywhere, (ANYWHERE_FORM,))) for w in of for f in forms]


DEFAULTS = default_rules()


def symbols_of(glob: str) -> list:
    """The places of a glob: *, ^, ? or |, or a byte of its UTF-8 form."""
    return [x for c in glob for x in ([c] if c in "*^?|" else c.encode())]


class Automaton:
    """The rules' bits: positions 0..n-1 of a pattern of n symbols, the last one accepts."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        symbols: list = []
        first, last = [], []
        for r in rules:
            if not r.glob:
                raise ValueError("an empty glob")
            first.append(len(symbols))
            symbols += symbols_of(r.glob)
            last.append(len(symbols) - 1)
        self.words = (len(symbols) + 63) // 64
        at = lambda places: self._pack(places, len(symbols))
        stars = [i for i, s in enumerate(symbols) if s in ("*", "^")]
        self.step = np.zeros((256, self.words), U)
        self.loop = np.zeros((256, self.words), U)
        for c in range(256):
            # ? moves on with the first byte of a character and stays for its others
            inside = 0x80 <= c < 0xC0
            border = c in b".-/"
            self.step[c] = at([i for i, s in enumerate(symbols) if s == c or s == "?" and not inside or s == "|" and border])
            self.loop[c] = at([i for i, s in enumerate(symbols) if s == "*" or s == "^" and c != ord("/") or s == "?" and inside])
        self.star, self.last = at(stars), last
        # a star may be empty: its bit is set as soon as the bit before it is, and it starts set
        self.first = at(first)
        self.chain = max((self._run(i, symbols, first) for i in stars), default=0)
        self.not_first = ~self.first
        self.start = self._closed(at([i for i in stars if i in first])[None, :])

    @staticmethod
    def _pack(places, n):
        out = np.zeros((n + 63) // 64, U)
        for i in places:
            out[i // 64] |= U(1) << U(i % 64)
        return out

    @staticmethod
    def _run(i, symbols, first):
        n = 1
        while i not in first and symbols[i - 1] in ("*", "^"):
            i, n = i - 1, n + 1
        return n

    def _shift(self, s):
        """One bit up across words, not into the first place of a pattern."""
        out = s << U(1)
        out[:, 1:] |= s[:, :-1] >> U(63)
        return out & self.not_first

    def _closed(self, s):
        for _ in range(self.chain):
            s = s | (self._shift(s) & self.star)
        return s

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """(texts, rules): whether the whole text fits the glob."""
        if not texts:
            return np.zeros((0, len(self.rules)), bool)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")  # those still running are a prefix
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])[order]
        size = size[order]
        state = np.repeat(self.start, len(texts), 0)
        fresh = True
        for k in range(int(size[0])):
            live = int(np.searchsorted(-size, -k, "left"))
            c = data[begin[:live] + k]
            s = state[:live]
            moved = self._shift(s)
            if fresh:
                moved |= self.first
                fresh = False
            state[:live] = self._closed((moved & self.step[c]) | (s & self.loop[c]) | (self._enter(moved) & self.loop[c]))
        bits = np.stack([(state[:, i // 64] >> U(i % 64)) & U(1) for i in self.last], 1).astype(bool)
        out = np.empty_like(bits)
        out[order] = bits
        return out

    def _enter(self, moved):
        return moved & self.star


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path): after the first :// up to / ? # with A-Z lower-cased; then up to ? or #."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.translate(LOWER), tail[:cut]


LOWER = {i: i + 32 for i in range(65, 91)}
FOLDED = LOWER | {ord(c): ord("-") for c in "_+ "}


def folded(host: str, path: str) -> str:
    """The form that the method's own globs see, of a url's host and path."""
    host = re.sub(r"\.+$", "", re.sub(":[0-9]*$", "", host.rpartition("@")[2]))
    if "%" in path:
        try:
            path = unquote_to_bytes(path).decode()
        except UnicodeDecodeError:
            pass  # as it is written
    path = path.translate(FOLDED)
    return f".{host}{'' if path.startswith('/') else '/'}{path}{'' if path.endswith('/') else '/'}"


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=None, defaults=None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The heaviest (longest) host rule that fits decides, ties by its place in the list; else the
    first default glob that fits the folded form, with a null rule; else allow. A null url, or one without ://,
    has an empty host and path and fits no rule. Long urls are simulated whole. Rows repeat as
    they occur, a null id stays null, other columns are ignored; an empty table gives an empty one.
    """
    rules, defaults = list(CONTRACT if rules is None else rules), list(DEFAULTS if defaults is None else defaults)

    def run(batches):
        import pyarrow as pa

        machine = Automaton(rules + defaults)
        order, n = sorted(range(len(rules)), key=lambda i: (-rules[i].weight, i)), len(rules)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                split = [canonical(u) for u in part.column(1).to_pylist()]
                known = [i for i, (h, p) in enumerate(split) if h or p]
                named, verdicts, open_ = [None] * len(split), ["allow"] * len(split), []
                fits = machine.fits([f".{split[i][0]}{split[i][1]}".encode() for i in known])[:, :n][:, order]
                for i, fit, best in zip(known, fits.any(1).tolist(), fits.argmax(1).tolist() if n else [0] * len(known)):
                    if fit:
                        named[i], verdicts[i] = rules[order[best]].name, rules[order[best]].verdict
                    else:
                        open_.append(i)
                fits = machine.fits([folded(*split[i]).encode() for i in open_])[:, n:]
                for i, fit, best in zip(open_, fits.any(1).tolist(), fits.argmax(1).tolist() if defaults else [0] * len(open_)):
                    if fit:
                        verdicts[i] = defaults[best].verdict
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(v, pa.string()) for v in ([h for h, _ in split], [p for _, p in split], named, verdicts))],
                    ["page_id", "host", "path", "rule", "verdict"],
                )

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string")).mapInArrow(lean(run), "page_id long, host string, path string, rule string, verdict string")


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
m AS (SELECT *, CASE
  WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM s),
f AS (SELECT *, '.' || regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS h,
  translate(coalesce(TRY(url_decode(path)), path), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_+ ', 'abcdefghijklmnopqrstuvwxyz---') AS p FROM m),
c AS (SELECT *, h || CASE WHEN starts_with(p, '/') THEN '' ELSE '/' END || p || CASE WHEN ends_with(p, '/') THEN '' ELSE '/' END AS form FROM f)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host = '' AND path = '' OR regexp_matches(form, '(?s)^[^/]*\.(PUBLIC/|(ac|PUBLIC)\.../)') THEN 'allow'
  WHEN regexp_matches(form, '(?s)[./-](UNWANTED)s?[./-]|^[^/]*(ANYWHERE)|^[^/]*[.-](IN_HOST)[./-]') THEN 'block' ELSE 'allow' END AS verdict FROM c
""".replace("UNWANTED", "|".join(UNWANTED)).replace("ANYWHERE", "|".join(ANYWHERE)).replace("IN_HOST", "|".join(IN_HOST)).replace("PUBLIC", f"({'|'.join(PUBLIC)})")
