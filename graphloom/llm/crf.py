"""A linear-chain conditional random field over word shapes, in numpy.

Text is cut into chunks (runs without white space) and chunks into tokens (letters, digits or
one other character); a line break is a token too. A token's score is the sum of hashed
features of the token, its neighbours, its chunk and the chunks around it. Features depend
only on the token type or the chunk, so each distinct one is scored once and the scores are
then gathered and added over whole batches of texts.

Training maximises the conditional likelihood with scaled forward-backward and Adam; the token's
spelling and the words around it are left out at random, so that shapes and classes of words
carry most of the weight and texts of other wording are read too.

Decoding is Viterbi over whole texts. A token whose score for "outside" exceeds every other
label's by more than all transitions around it could make good is outside on the best path of
any text; such tokens are settled at once and the texts fall into short stretches between
them, which are decoded exactly.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np

from graphloom.llm.pii_examples import DID, KINDS

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
L = len(LABELS)
ROWS = 1 << 17
_TOKEN = re.compile(r"[^\W\d_]+|\d+|.", re.S)
OWN, NEAR, AROUND = 23, 4, 5
#: Tokens times texts whose back pointers are held at a time.
CELLS = 1 << 20
#: General words of four languages that stand near personal information, or near what only looks like it.
CUES = {
    "phone": "phone telephone tel mobile cell fax hotline call called ring dial text helpline extension telefon handy mobil rufnummer anrufen ruf teléfono tel móvil llame llamar téléphone portable appelez appeler joindre",
    "mail": "mail email e-mail mailto mailbox write inbox cc bcc courriel correo adresse schreiben escriba écrivez",
    "id": "ssn nino passport identity id social security insurance national licence license driver driver's driving member membership tax medicare nhs health ausweis personalausweis reisepass reisepassnummer ausweisnummer führerschein versichertennummer versicherungsnummer sozialversicherungsnummer steuer-id mitgliedsnummer pasaporte dni nie nif nuss identidad afiliación socio conducir carné permiso seguridad passeport identité cni permis assuré adhérent sécu sécurité insured insurer policyholder permit citizen civil residence registration licencia asegurado asegurada cédula sanitaria vitale krankenkasse versichert versicherung conduire sociale adhérente assurée afiliado afiliada socia nir nss ni naf carnet subscriber beneficiary enrollee identification id-card idnr matricule titular legitimation carte-vitale licencia-de-conducir vital personnummer medicaid",
    "thing": "serial batch lot ticket case incident order invoice account iban card device terminal build revision reference tracking part asset meter router hash checksum version error port line seriennummer charge gerät vorgang rechnung konto kontonummer bestellung serie lote pedido factura cuenta incidencia série dossier facture compte commande",
    "title": "dr mr mrs ms miss prof professor sir madam frau herr herrn sr sra señor señora don doña m mme mlle monsieur madame nurse sister rev captain",
    "street": "street st road rd lane ln avenue ave drive dr court ct close way walk terrace place crescent square boulevard blvd row gardens quay calle c avenida av avda plaza paseo camino ronda travesía rue quai chemin allée impasse route bd straße strasse str platz weg gasse",
    "unit": "flat apt apartment unit suite floor room piso appt bâtiment étage box p.o po postfach apartado apdo boîte bp",
    "home": "lives address home deliver moved resident post postal ship billing wohnt anschrift vive domicilio habite",
    "org": "bank trust hospital clinic board committee council institute university group holdings ltd inc gmbh ag agency department foundation laboratory partners insurance company team office klinikum banco banque universität universidad université comité comisión commission consejo conseil junta ayuntamiento mairie société sociedad caja verein gesellschaft klinik ausschuss vorstand rat amt behörde authority association society union fondation fundación stiftung credit savings mutual services service council's panel chamber ministry ministerio ministère ministerium hôpital clínica clinique agencia agence",
    "role": "engineer manager analyst auditor architect tester operator director consultant clerk physician reviewer secretary coordinator customer patient author owner witness applicant kundin kunde clienta cliente client",
    "say": "approved asked said wrote agreed joined reviewed signed complained stated called met visited disagreed sagte schrieb aprobó dijo écrit validé",
    "greet": "dear hi hello thanks regards sincerely cheers cordialement saludo grüßen geehrte geehrter estimado estimada cher chère liebe lieber hola bonjour",
    "day": "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday januar februar märz mai juni juli oktober dezember enero febrero marzo abril mayo junio julio septiembre octubre diciembre janvier février avril juin juillet août septembre octobre décembre",
    "det": "the a an this that these each every any all no der die das den dem des ein eine einen einem einer eines kein keine jeder jede jedes dieser diese dieses zur zum im am beim vom ins el la los las un una unos unas este esta cada del al le les une ce cette chaque du des au aux",
    "link": "of in on at for with by from to into under over and or as if when von für mit nach bei aus auf und oder als wenn ohne durch gegen en con para por sobre entre y o si cuando dans avec pour par sur sans et ou quand",
    "be": "is are was were be been has have had shall must may should can ist sind war waren wird werden wurde hat haben muss soll kann es son era fue será tiene debe puede est sont était sera a doit peut not nicht no pas",
}
CUES["say"] += " " + " ".join(w for ws in DID.values() for v in ws for w in v.split() if len(w) > 3)
_CUE = {w: c for c, ws in reversed(CUES.items()) for w in ws.split()}
_COMPOUND = re.compile(r"\w\w(?:straße|strasse|str|weg|platz|allee|gasse|ufer|damm)\Z")
_PERSONAL = re.compile(r"(?:personal|reise)?(?:ausweis|pass)|(?:kranken|sozial|renten)?versicher|führerschein|mitglied|steuer-?id")


def cue(word: str) -> str:
    """The class of a lower-case word, or nothing; German compounds count by their parts."""
    known = _CUE.get(word)
    if known or len(word) < 4 or not word[0].isalpha():
        return known or ""
    return "street" if _COMPOUND.search(word) else "id" if _PERSONAL.match(word) else ""


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % (ROWS - 1) + 1  # row 0 stays zero


@functools.lru_cache(256)
def _few(s: str) -> int:
    return _h(s)


_EDGES = re.compile(r"^\W+|\W+$")
_CLASSES = {c: "9" if chr(c).isdigit() else "A" if chr(c).isupper() else "a" for c in range(128) if chr(c).isalnum()}
_DIGIT, _LETTER, _LOWER_RUN, _UPPER_RUN = (re.compile(p) for p in (r"\d", r"[^\W\d_]", r"a{2,}", r"A{3,}"))


@functools.lru_cache(1 << 17)
def shape(s: str) -> str:
    """Letters and digits by class; runs of letters are shortened, digits are kept one by one."""
    if s.isascii():
        x = s.translate(_CLASSES)
    else:
        x = _LETTER.sub(lambda m: "A" if m.group().isupper() else "a", _DIGIT.sub("9", s))
    return _LOWER_RUN.sub("a+", _UPPER_RUN.sub("A+", x))


def case_counts(texts: list[str]) -> dict[str, list[int]]:
    """Lower-case word -> [occurrences in lower case, all occurrences], of words that stand as a chunk, marks around them aside."""
    out: dict[str, list[int]] = {}
    for c, n in Counter(chain.from_iterable(t.split() for t in texts)).items():
        w = c.strip("<>()[].,;:!?\"'*_`")
        if w.isalpha():
            got = out.setdefault(w.lower(), [0, 0])
            got[0] += n * w.islower()
            got[1] += n
    return out


#: Words with at least one in COUNTED of all occurrences can be common; so there are never more than COUNTED.
COUNTED, LOWER_SHARE = 50_000, 0.2


def least_count(total: int) -> int:
    return max(2, -(-total // COUNTED))


def common(counts: dict[str, list[int]]) -> frozenset[str]:
    """Words that the collection writes in lower case often enough not to be a name where a capital begins them."""
    least = least_count(sum(n for _, n in counts.values()))
    return frozenset(w for w, (low, n) in counts.items() if low >= least and low >= LOWER_SHARE * n)


class Vocabulary:
    """Chunks and token types seen by this process, with the hashed features of each."""

    def __init__(self, given: frozenset[str], common: frozenset[str] = frozenset()):
        self.given, self.common = given, common
        self.chunks: dict[str, int] = {}
        # Tokens of all chunks, one after the other: type, start and end within the chunk, and where each chunk's begin.
        self.flat: list[list[int]] = [[], [], []]
        self.begin: list[int] = [0]
        self.arrays = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)]
        self.types: dict[tuple, int] = {}
        self.words, self.frames, self.sides, self.cores = {}, {}, {}, {}
        self.own: list[list[int]] = []
        self.near: list[list[int]] = []
        self.around: list[list[int]] = []
        self.shape_of: list[int] = []
        self.word_of: list[int] = []

    def chunk(self, c: str) -> int:
        got = self.chunks.get(c)
        if got is None:
            got = self._add(c)
        return got

    def _add(self, c: str) -> int:
        i = self.chunks[c] = len(self.chunks)
        if "\n" in c:
            word = sh = "\\n\\n" if c.count("\n") > 1 else "\\n"
            toks = [(word, 0, len(c))]
        else:
            word = c.strip("<>()[].,;:\"'").lower() or c
            sh = shape(c)
            toks = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(c)]
        core = shape(c.strip("<>()[],;:.\"'") or c)
        last = c[-1] if c[-1] in ".,;:)>]" else ""
        kind = cue(word)
        of_core = self.cores.get(core)
        if of_core is None:
            of_core = self.cores[core] = _h(f"d{core}"), _h(f"sh{core}")
        self.around.append([_h(f"c{word}"), of_core[0], _few(f"e{last}"), _few(f"g{self._listed(c)}"), _few(f"q{kind}")])
        self.shape_of.append(of_core[1])
        self.word_of.append(_few(f"wd{kind}"))
        ids = []
        n = len(toks)
        for k, (t, _, _) in enumerate(toks):
            key = (t, sh, core, min(k, 3), min(n - 1 - k, 3), "@" in c, toks[k - 1][0] if k else "", toks[k + 1][0] if k + 1 < n else "", kind)
            ids.append(self._type(key))
        self.flat[0].extend(ids)
        self.flat[1].extend(a for _, a, _ in toks)
        self.flat[2].extend(b for _, _, b in toks)
        self.begin.append(len(self.flat[0]))
        return i

    def tokens(self) -> list[np.ndarray]:
        """The flat lists as arrays; only what is new is converted."""
        for k, x in enumerate((*self.flat, self.begin)):
            n = len(self.arrays[k])
            if len(x) > n:
                self.arrays[k] = np.concatenate([self.arrays[k], np.array(x[n:], np.int64)])
        return self.arrays

    def _listed(self, c: str) -> str:
        w = c if c.isalnum() else _EDGES.sub("", c)
        low = w.lower()
        return ("G" if low in self.given else "") + ("L" if low in self.common else "") + ("C" if w[:1].isupper() and w[1:].islower() else "U" if w.isupper() and len(w) > 1 else "")

    def _type(self, key: tuple) -> int:
        i = self.types.get(key)
        if i is None:
            i = self.types[key] = len(self.own)
            t, sh, core, first, last, at, before, after, kind = key
            spelling, word, near, s = self.words.get(t) or self._word(t)
            frame = self.frames.get((s, sh, core, first, last, at, kind)) or self._frame(s, sh, core, first, last, at, kind)
            sides = self.sides.get((before, after, s)) or self._sides(before, after, s)
            self.own.append(spelling + word + frame + sides)  # spelling first: what training leaves out at random
            self.near.append(near)
        return i

    # The features of a type by what they depend on, each hashed once.
    def _word(self, t: str):
        low, s = t.lower(), shape(t)
        given = 2 * (low in self.given) + (low in self.common)
        spelling, word = [_h(f"0w{low}"), 0, 0, 0, 0], [_h(f"0s{s}"), _h(f"0g{given}|{s}")]
        if t.isalpha():
            spelling[1:] = _h(f"03{low[-3:]}"), _h(f"04{low[-4:]}"), _h(f"0b{low[:3]}"), _h(f"0b4{low[:4]}")
            word += [_h(f"02{low[-2:]}"), _h(f"0n{min(len(t), 9)}|{s}")]
        got = self.words[t] = spelling, word, [_h(f"n{low}"), _h(f"m{s}"), _h(f"k{given}{s}"), _h(f"3{low[-3:] if t.isalpha() else ''}")], s
        return got

    def _frame(self, s, sh, core, first, last, at, kind):
        f = (f"s{s}|{core}", f"x{core}|{first}", f"x{core}|{last}", f"y{sh}|{first}|{last}", f"p{first}", f"l{last}", f"@{at}|{s[:1]}", f"q{kind}|{s}", "bias")
        got = self.frames[s, sh, core, first, last, at, kind] = [_h("0" + x) for x in f]
        return got

    def _sides(self, before, after, s):
        plain = lambda x: x.lower() if x.isalpha() else x
        got = self.sides[before, after, s] = [_h(f"0<{plain(before)}|{s}"), _h(f"0>{plain(after)}|{s}"), _h(f"0<>{shape(before)}|{shape(after)}")]
        return got


def _salted(ids: np.ndarray, offset: int) -> np.ndarray:
    """The same features at another offset have rows of their own."""
    out = (ids.astype(np.int64) * (2 * offset + 19) + offset * 7919) % (ROWS - 1) + 1
    return np.where(ids == 0, 0, out)


def _pad(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


#: The first own features are those of spelling.
SPELLING = 5
TOKEN_OFFSETS, CHUNK_OFFSETS = (-2, -1, 1, 2), (-3, -2, -1, 1, 2, 3)


_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def _cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(chunks, start of each in its text, text of each): runs without white space, and runs of it with a line break."""
    whole = " ".join(texts) + " "
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    space = _SPACE[np.minimum(code, 0x3001)]
    own = np.ones(len(code), bool)
    own[begin + sizes - 1] = False  # the blank between two texts belongs to none
    edge = np.concatenate([[True], (space[1:] != space[:-1]) | ~own[:-1]])
    start = np.flatnonzero(edge)
    lines = np.add.reduceat((code == 10) & own, start, dtype=np.int64)
    filled = ~space[start]
    kept = filled | (lines > 0)
    chunks = np.empty(len(start), dtype=object)
    chunks[filled] = whole.split()
    chunks[lines == 1] = "\n"
    chunks[lines > 1] = "\n\n"
    start = start[kept]
    text_of = np.searchsorted(begin, start, "right") - 1
    return chunks[kept].tolist(), start - begin[text_of], text_of


class Batch:
    """Tokens of several texts: types, chunks, places; contexts do not cross texts."""

    def __init__(self, texts: list[str], v: Vocabulary):
        chunks, at, self.chunk_text = _cut(texts)
        ids = list(map(v.chunks.get, chunks))
        if None in ids:
            ids = [v.chunk(c) if i is None else i for c, i in zip(chunks, ids)]
        types, starts, ends, begin = v.tokens()
        self.chunk_ids = np.array(ids, np.int64)
        first = begin[self.chunk_ids]
        n = begin[self.chunk_ids + 1] - first
        self.chunk_of = np.repeat(np.arange(len(ids)), n)
        i = np.arange(len(self.chunk_of)) - np.repeat(np.cumsum(n) - n - first, n)
        self.types, self.starts, self.ends = types[i], starts[i] + at[self.chunk_of], ends[i] + at[self.chunk_of]
        self.text_of = self.chunk_text[self.chunk_of]


def _shifted(values: np.ndarray, owner: np.ndarray, k: int, none: int) -> np.ndarray:
    """values[i + k] where it belongs to the same owner, else ``none``."""
    out = np.full(len(values), none, dtype=np.int64)
    if abs(k) < len(values):
        if k > 0:
            same = owner[k:] == owner[:-k]
            out[:-k] = np.where(same, values[k:], none)
        else:
            same = owner[:k] == owner[-k:]
            out[-k:] = np.where(same, values[:k], none)
    return out


def _pairs(b: Batch, v: Vocabulary) -> list[np.ndarray]:
    """Feature rows of chunk pairs: the class of the word before (or two before, or after) with the own shape."""
    sh, wd = np.array(v.shape_of), np.array(v.word_of)
    own = sh[b.chunk_ids]
    out = []
    for k, salt in ((-1, 31), (1, 37), (-2, 41)):
        other = _shifted(wd[b.chunk_ids], b.chunk_text, k, 1)
        out.append((own * 131 + other * salt) % (ROWS - 1) + 1)
    return out


def features(b: Batch, v: Vocabulary) -> np.ndarray:
    """All feature rows of each token, as a matrix; for training on a small table."""
    own, near, around = _pad(v.own, OWN), _pad(v.near, NEAR), _pad(v.around, AROUND)
    edge_t, edge_c = np.vstack([near, np.full((1, NEAR), 7)]), np.vstack([around, np.full((1, AROUND), 7)])
    cols = [own[b.types]]
    for k in TOKEN_OFFSETS:
        cols.append(_salted(edge_t[_shifted(b.types, b.text_of, k, len(near))], k))
    for k in CHUNK_OFFSETS:
        cols.append(_salted(edge_c[_shifted(b.chunk_ids, b.chunk_text, k, len(around))], 20 + k)[b.chunk_of])
    cols += [p[b.chunk_of][:, None] for p in _pairs(b, v)]
    return np.hstack(cols)


class Model:
    """Weights, the list of given names and the collection's common words (see ``common``)."""

    def __init__(self, w: np.ndarray, trans: np.ndarray, given: frozenset[str], common: frozenset[str] = frozenset()):
        self.w, self.trans, self.given, self.common = w, trans, given, common
        self.reset()

    def reset(self) -> None:
        self.v = Vocabulary(self.given, self.common)
        self.s_own = np.zeros((0, L), np.float32)
        self.s_near = {k: np.zeros((0, L), np.float32) for k in TOKEN_OFFSETS}
        self.s_around = {k: np.zeros((0, L), np.float32) for k in CHUNK_OFFSETS}

    def _grow(self) -> None:
        """Scores of the types and chunks that are new since the last batch."""
        v, w = self.v, self.w
        n = len(self.s_own)
        if len(v.own) > n:
            self.s_own = np.vstack([self.s_own, w[_pad(v.own[n:], OWN)].sum(1)])
            near = _pad(v.near[n:], NEAR)
            for k in TOKEN_OFFSETS:
                self.s_near[k] = np.vstack([self.s_near[k], w[_salted(near, k)].sum(1)])
        n = len(self.s_around[1])
        if len(v.around) > n:
            around = _pad(v.around[n:], AROUND)
            for k in CHUNK_OFFSETS:
                self.s_around[k] = np.vstack([self.s_around[k], w[_salted(around, 20 + k)].sum(1)])

    def scores(self, b: Batch) -> np.ndarray:
        self._grow()
        e = self.s_own[b.types]
        for k in TOKEN_OFFSETS:
            edge = self.w[_salted(np.full((1, NEAR), 7), k)].sum(1)
            s = np.vstack([self.s_near[k], edge])
            e += s[_shifted(b.types, b.text_of, k, len(s) - 1)]
        c = np.zeros((len(b.chunk_ids), L), np.float32)
        for k in CHUNK_OFFSETS:
            edge = self.w[_salted(np.full((1, AROUND), 7), 20 + k)].sum(1)
            s = np.vstack([self.s_around[k], edge])
            c += s[_shifted(b.chunk_ids, b.chunk_text, k, len(s) - 1)]
        for p in _pairs(b, self.v):
            c += self.w[p]
        return e + c[b.chunk_of]

    def spans(self, texts: list[str]) -> list[tuple[int, str, int, int]]:
        """(text number, kind, start, end) of every finding."""
        if len(self.v.own) > 400_000:
            self.reset()
        b = Batch(texts, self.v)
        if not len(b.types):
            return []
        y = viterbi(self.scores(b), self.trans, b.text_of)
        kind, begins = (y + 1) // 2, (y % 2 == 1)
        first = np.flatnonzero(begins | ((y > 0) & (np.concatenate([[0], kind[:-1]]) != kind)) | ((y > 0) & (np.concatenate([[-1], b.text_of[:-1]]) != b.text_of)))
        out = []
        for i in first:
            j = i
            while j + 1 < len(y) and y[j + 1] == 2 * kind[i] and b.text_of[j + 1] == b.text_of[i]:
                j += 1
            out.append((int(b.text_of[i]), KINDS[kind[i] - 1], int(b.starts[i]), int(b.ends[j])))
        return out


def allowed() -> np.ndarray:
    """Transition mask: an inside label follows only its own kind."""
    ok = np.ones((L, L), bool)
    for i in range(2, L, 2):
        ok[:, i] = False
        ok[i - 1, i] = ok[i, i] = True
    return ok


def settled(e: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Tokens that are outside on every best path; ``first`` and ``last`` mark the ends of texts.

    Calling all tokens of a finding O is always allowed and changes the score by its tokens'
    margins and by transitions, which are bounded over all labels. Of a best path no finding may
    lose by that. The most that any finding of a kind through a token could gain is a bound for
    its ends, the token's own margin and the best sums of margins to its left and right.
    """
    ok = allowed()
    outer = [0, *range(1, L, 2)]
    sure = np.ones(len(e), dtype=bool)
    for b in range(1, L, 2):
        i = b + 1
        begin = max(0.0, max(trans[a, b] - trans[a, 0] for a in range(L) if ok[a, b]))
        end = max(0.0, max(trans[x, c] - trans[0, c] for x in (b, i) for c in outer))
        on = max(trans[b, i], trans[i, i]) - trans[0, 0]
        u = (np.maximum(e[:, b], e[:, i] + on) - e[:, 0]).astype(np.float64)
        gain = u + _sums(u, first) + _sums(u[::-1], last[::-1])[::-1]
        sure &= gain + begin + end < -1e-3
    return sure


def _sums(u: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest sum, at least 0, of values right before each place, back to the start of its text at most."""
    total = np.concatenate([[0.0], np.cumsum(u)])[:-1]  # before each place
    group = np.cumsum(first)
    # The least total so far within a text: texts are set apart by more than any sum.
    apart = (np.abs(total).max() if len(total) else 0.0) * 2 + 1
    return total - (np.minimum.accumulate(total - group * apart) + group * apart)


def viterbi(e: np.ndarray, trans: np.ndarray, text_of: np.ndarray, gate: bool = True) -> np.ndarray:
    """Best labels of all tokens, each text decoded whole; without ``gate`` nothing is settled beforehand."""
    n = len(text_of)
    first = np.concatenate([[True], text_of[1:] != text_of[:-1]])
    last = np.concatenate([first[1:], [True]])
    y = np.zeros(n, dtype=np.int64)
    open_ = ~settled(e, trans, first, last) if gate else np.ones(n, dtype=bool)
    prev_open = np.concatenate([[False], open_[:-1]]) & ~first
    next_open = np.concatenate([open_[1:], [False]]) & ~last
    start, end = np.flatnonzero(open_ & ~prev_open), np.flatnonzero(open_ & ~next_open) + 1
    size = end - start
    order = np.argsort(size, kind="stable")
    start, size = start[order], size[order]
    t32 = np.where(allowed(), trans, -1e4).astype(np.float32)
    into = np.where(first[start][:, None], np.where(allowed()[0], 0, -1e4), t32[0]).astype(np.float32)
    out_of = np.where(last[start + size - 1][:, None], 0, t32[:, 0]).astype(np.float32)
    i = 0
    while i < len(start):
        j = i + 1
        while j < len(start) and (j + 1 - i) * size[j] <= CELLS and size[j] <= 2 * size[i] + 2:
            j += 1
        y_at, lab = _stretches(e, t32, start[i:j], size[i:j], into[i:j], out_of[i:j])
        y[y_at] = lab
        i = j
    return y


def _stretches(e: np.ndarray, t32: np.ndarray, a: np.ndarray, n: np.ndarray, into: np.ndarray, out_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, labels) of stretches that begin at ``a``, sorted by their length ``n``."""
    longest, many = int(n[-1]), len(a)
    back = np.zeros((longest, many, L), np.int8)
    d = e[a] + into
    done = np.searchsorted(n, np.arange(longest + 1), "right")  # stretches of at most k tokens
    for k in range(1, longest):
        live = done[k]  # those from here on are longer than k
        sums = d[live:, :, None] + t32
        arg = sums.argmax(1)
        back[k, live:] = arg
        best = sums.max(1) + e[a[live:] + k]
        d[live:] = best - best.max(1, keepdims=True)  # small numbers keep their precision
    lab = (d + out_of).argmax(1)
    path = np.zeros((longest, many), dtype=np.int64)
    cols = np.arange(many)
    for k in range(longest - 1, -1, -1):
        path[k] = lab
        if k:
            live = done[k]
            lab[live:] = back[k, cols[live:], lab[live:]]
    mask = np.arange(longest)[:, None] < n
    return (a + np.arange(longest)[:, None])[mask], path[mask]


class _Fold:
    """A part of the labelled table as arrays: features, gold labels and their order by feature."""

    def __init__(self, f: np.ndarray, y: np.ndarray, lengths: np.ndarray):
        self.ids, self.y, self.n = f, y, len(lengths)
        flat = f.ravel()
        order = np.argsort(flat, kind="stable")
        self.token = (order // f.shape[1]).astype(np.int32)
        self.bounds = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) > 0]))
        self.rows = flat[order][self.bounds]
        first = np.cumsum(lengths) - lengths
        step = np.arange(int(lengths.max()))[:, None]
        self.live = step < lengths
        self.idx = np.minimum(first + step, len(y) - 1)
        self.gold = np.zeros((L, L))
        both = self.live[1:] & self.live[:-1]
        np.add.at(self.gold, (y[self.idx[:-1]][both], y[self.idx[1:]][both]), 1)
        self.onehot = np.eye(L, dtype=np.float32)[y]

    def gradient(self, w: np.ndarray, tr: np.ndarray, mask: np.ndarray):
        """Observed less expected counts by feature (of self.rows) and by transition, a text."""
        e = w[self.ids].sum(1)
        pot = np.exp(e - e.max(1, keepdims=True))[self.idx]  # time, text, label
        a = (np.exp(tr) * mask).astype(np.float32)
        live, longest = self.live, len(self.idx)
        alpha, scale = np.zeros(pot.shape, np.float32), np.ones(pot.shape[:2], np.float32)
        alpha[0] = pot[0] * mask[0]
        for k in range(longest):
            if k:
                alpha[k] = np.where(live[k][:, None], (alpha[k - 1] @ a) * pot[k], alpha[k - 1])
            scale[k] = alpha[k].sum(1)
            alpha[k] /= scale[k][:, None]
        beta = np.ones(pot.shape, np.float32)
        expected = np.zeros((L, L))
        for k in range(longest - 1, 0, -1):
            right = beta[k] * pot[k]
            z = np.where(live[k], scale[k], 1)
            lv = live[k][:, None]
            expected += ((alpha[k - 1] * lv / z[:, None]).T @ (right * lv)) * a
            beta[k - 1] = np.where(lv, (right @ a.T) / z[:, None], beta[k])
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        g = self.onehot.copy()
        g[self.idx[live]] -= post[live]
        return np.add.reduceat(g[self.token], self.bounds, axis=0) / self.n, (self.gold - expected) / self.n


def _fold(rows: list[tuple[str, list[tuple[int, int, str]]]], v: Vocabulary, rng: np.random.Generator, drop: float, drop_near: float) -> _Fold:
    """Features of some rows with their gold labels. What is left out at random stands as a feature of its own, so that the others need not make up for it."""
    b = Batch([t for t, _ in rows], v)
    f = features(b, v).astype(np.int32)
    f[np.ix_(rng.random(len(f)) < drop, np.arange(SPELLING))] = _h("spelling left out")
    words = [OWN + NEAR * i + j for i in range(len(TOKEN_OFFSETS)) for j in (0, 3)] + [OWN + NEAR * len(TOKEN_OFFSETS) + AROUND * i for i in range(len(CHUNK_OFFSETS))]
    for group in (words[: 2 * len(TOKEN_OFFSETS)], words[2 * len(TOKEN_OFFSETS) :]):
        f[np.ix_(rng.random(len(f)) < drop_near, group)] = _h("words left out")
    y = np.zeros(len(b.types), dtype=np.int64)
    lengths = np.bincount(b.text_of, minlength=len(rows))
    ends = np.cumsum(lengths)
    for d, (_, spans) in enumerate(rows):
        inside = np.arange(ends[d] - lengths[d], ends[d])
        for s, t, kind in spans:
            got = inside[(b.starts[inside] >= s) & (b.ends[inside] <= t)]
            y[got] = 2 + 2 * KINDS.index(kind)
            y[got[:1]] = 1 + 2 * KINDS.index(kind)
    return _Fold(f, y, lengths[lengths > 0])


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], given: frozenset[str], passes: int = 6, folds: int = 24, rate: float = 0.05, l2: float = 1e-4, drop: float = 0.3, drop_near: float = 0.8) -> Model:
    v = Vocabulary(given, common(case_counts([t for t, _ in rows])))
    rng = np.random.default_rng(3)
    parts = [_fold(rows[k::folds], v, rng, drop, drop_near) for k in range(folds) if rows[k::folds]]
    w, tr = np.zeros((ROWS, L), np.float32), np.zeros((L, L))
    mask = allowed()
    moments = [np.zeros_like(x) for x in (w, w, tr, tr)]
    steps, w_sum, tr_sum, summed = 0, np.zeros_like(w), np.zeros_like(tr), 0
    for epoch in range(passes):
        for part in parts:
            steps += 1
            if epoch >= passes // 2:  # the mean of the later steps varies less than the last one
                w_sum += w
                tr_sum, summed = tr_sum + tr, summed + 1
            gw, gt = part.gradient(w, tr, mask)
            full = -l2 * w
            full[part.rows] += gw
            full[0] = 0  # the row of what is left out
            now = rate * (1 - 0.8 * epoch / passes)
            for p, g, m, s in ((w, full, moments[0], moments[1]), (tr, gt - l2 * tr, moments[2], moments[3])):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p += now * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-8)
    return Model(w_sum / max(1, summed), tr_sum / max(1, summed), given)
