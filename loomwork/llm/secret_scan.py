"""Secret scans with one combined deterministic automaton over bytes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import parts, texts_buffer


@dataclass(frozen=True)
class Rule:
    """A regex over bytes (literals, classes, groups, |, ?, *, +, {n,}); a match that isn't wholly a ``keep`` is dropped, no retries.

    Fields: name of the kind, pattern, ``keep``, whether it is a base kind, whether letters match in either case, ``tail``."""

    kind: str
    pattern: str
    keep: str = ""
    base: bool = False
    fold: bool = False
    tail: str = ""  # what belongs to a match and may hold any byte: tried where a match ends


# Patterns and order of the three base kinds, then token formats published by their issuers.
RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", r"[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}", True, True),
    Rule("access", r"AKIA[A-Z0-9]+", r".{20,}", True),
    Rule("hex", r"[0-9a-f]{24,}", "", True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r".{40,}"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]+", r".{50,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", r".{26,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r".{15,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]+", r".{60,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]+", r".{39}"),
    Rule("google_oauth", r"ya29\.[0-9A-Za-z_-]+", r".{30,}"),
    Rule("stripe", r"[sr]k_(live|test)_[0-9A-Za-z]+", r".{24,}"),
    Rule("npm", r"npm_[A-Za-z0-9]+", r".{40}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]+", r".{60,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r".{60,}"),
    Rule("twilio", r"(AC|SK)[0-9a-f]+", r".{34}"),
    Rule("digitalocean", r"do[opr]_v1_[0-9a-f]+", r".{71}"),
    Rule("huggingface", r"hf_[A-Za-z]+", r".{37}"),
    Rule("shopify", r"shp(at|ca|pa|ss)_[0-9a-f]+", r".{38}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]+", r".{27,}", False, True),
    Rule("url_password", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._~!*+=-]+@", r".{8,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r".{40,}"),
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----", "", tail=r"(?:-?[^-])*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=\s]*"),
)


# --- regex to nondeterministic automaton --------------------------------------------------


@dataclass
class _Nfa:
    step: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1


def _build(nfa: _Nfa, pattern: str, fold: bool) -> tuple[int, int]:
    """(first, last) state of the fragment for ``pattern``."""
    at = 0

    def letters(chars: set[int]) -> frozenset[int]:
        return frozenset(chars | {b ^ 32 for b in chars if chr(b).isalpha()} if fold else chars)

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
        return ord(c)

    def atom() -> tuple[int, int]:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            got = choice()
            at += 1
            return got
        if pattern[at] == "[":
            at += 1
            chars: set[int] = set()
            while pattern[at] != "]":
                low = char()
                high = low
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = char()
                chars.update(range(low, high + 1))
            at += 1
        else:
            chars = {char()}
        a, b = nfa.state(), nfa.state()
        nfa.step[a].append((letters(chars), b))
        return a, b

    def piece() -> tuple[int, int]:
        nonlocal at
        began = at
        a, b = atom()
        if at < len(pattern) and pattern[at] in "?*+":
            if pattern[at] in "?*":
                nfa.free[a].append(b)
            if pattern[at] in "*+":
                nfa.free[b].append(a)
            at += 1
        elif at < len(pattern) and pattern[at] == "{":
            least, past = int(pattern[at + 1 : pattern.index(",", at)]), pattern.index("}", at) + 1
            for _ in range(least - 1):
                at = began
                c, d = atom()
                nfa.free[b].append(c)
                last, b = c, d
            nfa.free[b].append(last if least > 1 else a)
            at = past
        return a, b

    def run() -> tuple[int, int]:
        first = last = nfa.state()
        while at < len(pattern) and pattern[at] not in "|)":
            a, b = piece()
            nfa.free[last].append(a)
            last = b
        return first, last

    def choice() -> tuple[int, int]:
        nonlocal at
        first, last = nfa.state(), nfa.state()
        while True:
            a, b = run()
            nfa.free[first].append(a)
            nfa.free[b].append(last)
            if at >= len(pattern) or pattern[at] != "|":
                return first, last
            at += 1

    return choice()


@dataclass(frozen=True)
class Automaton:
    """Transition array over byte classes; accept[s] has bit r set where rule r has a match that ends here.
    State 0 is the start; with ``dead`` >= 0 that state is left no more."""

    table: np.ndarray
    byte_class: np.ndarray
    accept: np.ndarray
    dead: int
    alphabet: np.ndarray  # whether some pattern can hold the byte
    rows: list = field(repr=False)
    ok: list = field(repr=False)
    code: bytes = b""  # byte_class for bytes.translate


def _least(table: np.ndarray, accept: np.ndarray) -> np.ndarray:
    """The group of each state in the smallest automaton: groups are split until all states of one go to the same groups.

    Rows are compared by a 64-bit sum in each round; the last groups are compared row by row, so equal sums of different rows change nothing but the number of rounds."""
    weight = np.random.default_rng(1).integers(1, 1 << 63, table.shape[1] + 1, dtype=np.uint64) | np.uint64(1)
    group = np.unique(accept, return_inverse=True)[1]
    while True:
        key = group.astype(np.uint64) * weight[0]
        for c in range(table.shape[1]):
            key += (group[table[:, c]].astype(np.uint64) + np.uint64(1)) * weight[c + 1]
        finer = np.unique(np.stack((group.astype(np.uint64), key), 1).view([("g", "u8"), ("k", "u8")]).ravel(), return_inverse=True)[1]
        if finer.max() > group.max():
            group = finer
            continue
        _, first = np.unique(group, return_index=True)
        if np.array_equal(group[table], group[table[first[group]]]):
            return group
        group = np.unique(np.concatenate((group[:, None], group[table]), axis=1), axis=0, return_inverse=True)[1].ravel()


def compile_rules(patterns: list[tuple[str, bool]], anywhere: bool, backward: bool = False, shortest: bool = False) -> Automaton:
    """Subset construction and minimisation of all patterns into one automaton.

    anywhere: a match may begin at any byte. backward: the automaton reads texts from their end.
    shortest: a rule's states are dropped once it has accepted, which keeps the automaton small where only hits matter.
    """
    nfa = _Nfa()
    ends, owner = [], []
    for r, (p, f) in enumerate(patterns):
        ends.append(_build(nfa, p, f))
        owner += [r] * (len(nfa.step) - len(owner))
    n = len(nfa.step)
    step, free, starts, finals = nfa.step, nfa.free, [a for a, _ in ends], {b: 1 << r for r, (_, b) in enumerate(ends)}
    if backward:
        step, free = [[] for _ in range(n)], [[] for _ in range(n)]
        for a in range(n):
            for chars, b in nfa.step[a]:
                step[b].append((chars, a))
            for b in nfa.free[a]:
                free[b].append(a)
        starts, finals = [b for _, b in ends], {a: 1 << r for r, (a, _) in enumerate(ends)}

    def closure(state: int) -> int:
        seen, todo = {state}, [state]
        while todo:
            for b in free[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return sum(1 << x for x in seen)

    sets = list(dict.fromkeys(chars for s in step for chars, _ in s))
    profile = [tuple(b in chars for chars in sets) for b in range(256)]
    names = {p: i for i, p in enumerate(dict.fromkeys(profile))}
    byte_class = np.array([names[p] for p in profile], np.uint8)
    sample = [profile.index(p) for p in names]

    # A set of states is one integer, bit s for state s; moves[s] has (byte class, closed set reached).
    closed = [closure(s) for s in range(n)]
    moves = [[(c, closed[b]) for chars, b in step[s] for c, byte in enumerate(sample) if byte in chars] for s in range(n)]
    useful = sum(1 << s for s in range(n) if moves[s])
    final = sum(1 << s for s in finals)
    own = [sum(1 << s for s in range(n) if owner[s] == r) for r in range(len(patterns))]
    begin = 0
    for s in starts:
        begin |= closed[s]

    def bits(x: int) -> list[int]:
        out = []
        while x:
            out.append((x & -x).bit_length() - 1)
            x &= x - 1
        return out

    number, order, rows = {begin: 0}, [begin], []
    while len(rows) < len(order):
        row = [begin if anywhere else 0] * len(sample)
        for s in bits(order[len(rows)] & useful):
            for c, to in moves[s]:
                row[c] |= to
        for c, to in enumerate(row):
            if shortest and to & final:
                for r in {owner[x] for x in bits(to & final)}:
                    to &= ~own[r] | final
                to |= begin
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row[c] = number[to]
        rows.append(row)
    table = np.array(rows, np.int32)
    accept = np.array([sum(finals[s] for s in bits(x & final)) for x in order], np.int32)
    group = _least(table, accept)
    rank = {g: i for i, g in enumerate(dict.fromkeys(group.tolist()))}  # the start stays 0
    group = np.array([rank[g] for g in group.tolist()])
    pick = np.unique(group, return_index=True)[1]
    table, accept = group[table[pick]].astype(np.int32), accept[pick]
    dead = np.flatnonzero((table == np.arange(len(table))[:, None]).all(1) & (accept == 0))
    return Automaton(
        table, byte_class, accept, -1 if anywhere or not len(dead) else int(dead[0]),
        np.array([any(b in chars for chars in sets) for b in range(256)]), table.tolist(), accept.tolist(), byte_class.tobytes(),
    )


# --- scanning -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    seek: Automaton
    starts: Automaton
    each: tuple[Automaton, ...]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    p = [(r.pattern, r.fold) for r in rules]
    # Read from the end, a counted run would be counted from every byte: one repeat has the same leftmost starts here.
    loose = [(re.sub(r"\{\d+,\}", "+", x), f) for x, f in p]
    return Scanner(rules, compile_rules(p, True, shortest=True), compile_rules(loose, True, True), tuple(compile_rules([x], False) for x in p))


_LONG = 2048


def _lanes(data: np.ndarray, offsets: np.ndarray, a: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of the texts cut at every byte that no rule can hold: no match spans one."""
    cut = ~a.alphabet[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~cut
    first = inside & (np.concatenate(([True], cut[:-1])) | edge[:-1])
    last = inside & (np.concatenate((cut[1:], [True])) | edge[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hits(data: np.ndarray, offsets: np.ndarray, a: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, rules) of the stretches in which some rule matches; all stretches step through the automaton together."""
    start, end = _lanes(data, offsets, a)
    size = end - start
    order = np.argsort(-size, kind="stable")
    start, end, size = start[order], end[order], size[order]
    found = np.zeros(len(start), np.int32)
    flat, width = a.table.ravel(), a.table.shape[1]
    cls = a.byte_class[data].astype(np.int32)
    long = int(np.searchsorted(-size, -_LONG))
    rows, accept = a.rows, a.ok
    for lane in range(long):
        s = got = 0
        for c in cls[start[lane] : end[lane]].tolist():
            s = rows[s][c]
            got |= accept[s]
        found[lane] = got
    state = np.zeros(len(start) - long, np.int32)
    at, sizes, got = start[long:], size[long:], found[long:]
    for j in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -j))  # lanes longer than j come first
        s = flat[state[:live] * width + cls[at[:live] + j]]
        state[:live] = s
        got[:live] |= a.accept[s]
    keep = found != 0
    return start[keep], end[keep], found[keep]


def _spans(sc: Scanner, piece: bytes, rules: int) -> list[tuple[int, int, int]]:
    """(start, rule, end) of the leftmost, longest, non-overlapping matches of each rule that pass its test."""
    rows, accept = sc.starts.rows, sc.starts.ok
    begin = [0] * len(piece)
    s, codes = 0, piece.translate(sc.starts.code)
    for i in range(len(piece) - 1, -1, -1):
        s = rows[s][codes[i]]
        begin[i] = accept[s]
    out = []
    for r, rule in enumerate(sc.rules):
        if not rules >> r & 1:
            continue
        a = sc.each[r]
        table, ok, codes = a.rows, a.ok, piece.translate(a.code)
        at = 0
        while at < len(piece):
            if not begin[at] >> r & 1:
                at += 1
                continue
            s, i, last = 0, at, -1
            while i < len(piece):
                s = table[s][codes[i]]
                if s == a.dead:
                    break
                i += 1
                if ok[s]:
                    last = i
            if last < 0:  # a run too short for a counted rule: its later bytes are too
                at = max(i, at + 1)
                continue
            if not rule.keep or re.fullmatch(rule.keep.encode(), piece[at:last], re.S):
                out.append((at, r, last))
            at = last
    return out


def _extended(sc: Scanner, text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with their rules' tails; a match inside the tail of another of its rule is part of it."""
    out, done = [], {}
    for s, r, e in sorted(spans):
        if s >= done.get(r, 0):
            if sc.rules[r].tail:
                e = done[r] = re.compile(sc.rules[r].tail.encode()).match(text, e).end()
            out.append((s, r, e))
    return out


def find_secrets(text: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, by start and rule, of one text."""
    data, found = np.frombuffer(text, np.uint8), []
    sc = scanner(rules)
    for a, b, hit in zip(*_hits(data, np.array([0, len(data)]), sc.seek), strict=True):
        found += [(a + s, r, a + e) for s, r, e in _spans(sc, text[a:b], int(hit))]
    return _extended(sc, text, found)


def _batch_spans(column: pa.Array, sc: Scanner) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict]]:
    """For ranges of rows: first row, bytes, offsets, and row -> its spans in bytes within the row."""
    data, offsets = texts_buffer(column)
    for low, high in parts(offsets, 2 << 20):
        base = offsets[low]
        d, o = data[base : offsets[high]], offsets[low : high + 1] - base
        by_row: dict[int, list] = {}
        starts, ends, hits = _hits(d, o, sc.seek)
        for a, b, hit, row in zip(starts, ends, hits, np.searchsorted(o, starts, "right") - 1, strict=True):
            got = _spans(sc, d[a:b].tobytes(), int(hit))
            if got:
                by_row.setdefault(int(row), []).extend((int(a - o[row]) + s, r, int(a - o[row]) + e) for s, r, e in got)
        tails = {r for r, x in enumerate(sc.rules) if x.tail}
        for row, got in by_row.items():
            if any(x[1] in tails for x in got):
                by_row[row] = _extended(sc, d[o[row] : o[row + 1]].tobytes(), got)
        yield low, d, o, by_row


def _characters(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    places = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    at = lambda i: int(places[i - 1]) if i else 0
    return [(at(s), r, at(e)) for s, r, e in sorted(spans)]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans) for each row of documents.

    Spans are kind:start:end in code points, by start and then rule order. That of a private key goes to its END line, or, without one,
    over the letters of its body. A null or empty text has none (its base_sha256 is
    that of an empty string). Rows come out one for one, also repeated rows and rows with a null doc_id; other columns are ignored.
    """
    base = [r for r, x in enumerate(rules) if x.base]
    names = [f"n_{rules[r].kind}" for r in base]
    sc = scanner(rules)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda spans: ",".join(f"{rules[r].kind}:{s}:{e}" for s, r, e in spans)
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for low, d, o, by_row in _batch_spans(batch.column(1), sc):
                n = len(o) - 1
                counts, sha, spans = {r: np.zeros(n, np.int64) for r in base}, [nothing] * n, [""] * n
                for row, found in by_row.items():
                    found = _characters(d[o[row] : o[row + 1]].tobytes(), found)
                    own = [x for x in found if x[1] in counts]
                    for _, r, _ in own:
                        counts[r][row] += 1
                    sha[row], spans[row] = hashlib.sha256(told(own).encode()).hexdigest(), told(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), *(pa.array(counts[r]) for r in base), pa.array(sha), pa.array(spans)],
                    ["doc_id", *names, "base_sha256", "spans"],
                )

    schema = "doc_id bigint, " + ", ".join(f"{x} bigint" for x in names) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(each, schema)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; each stretch covered by spans becomes ``mask``, and n_chars follows where a text changed."""
    sc = scanner(rules)
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, d, o, by_row in _batch_spans(batch.column(at), sc):
                n = len(o) - 1
                part = batch.slice(low, n)
                if by_row:
                    texts = part.column(at).to_pylist()
                    for row, found in by_row.items():
                        raw, out, end = d[o[row] : o[row + 1]].tobytes(), [], 0
                        for s, _, e in sorted(found):
                            if s >= end:
                                out += [raw[end:s], mask.encode()]
                            end = max(end, e)
                        texts[row] = b"".join([*out, raw[end:]]).decode()
                    columns = list(part.columns)
                    columns[at] = pa.array(texts, part.column(at).type)
                    if "n_chars" in part.schema.names:
                        k = part.schema.names.index("n_chars")
                        sizes = part.column(k).to_pylist()
                        for row in by_row:
                            sizes[row] = len(texts[row])
                        columns[k] = pa.array(sizes, part.column(k).type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(each, docs.schema)
