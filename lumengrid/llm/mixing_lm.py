r"""Language-model scores by online logistic context mixing, beside a unigram base score.

A text is the bytes of its lower-cased words, joined by single spaces, and an end mark. Every byte is a path of binary
decisions through a Huffman tree that depends on the byte or two before it within the word, so that likely bytes need few.
For each decision several predictors look up how often it went one way after their own hashed context: the word so far; the
word so far and the whole word before it; the last five bytes, across words; and the byte that followed the last place in
the same text where six bytes were the same. Predictions are mixed in the logistic domain. A gate, made of the
confidence of the predictors, selects a set of weights; the weights start from those learned on all documents to learn from
and go on learning inside each text, block by block. A map from gate and mix to what was seen refines them. Documents are in
two halves, each with tables of its own, and teach the weights by the tables of the other half, which have not seen them.
Inputs are few bits, so tasks count how often each gate and inputs met each decision, and the weights of a gate are where
the steps of online learning cancel over all that was counted.

Tables are filled from running text by tasks and summed shard by shard. What would not fit into tables of bounded size is
kept as Spark tables that grow with the corpus: word counts for the base score, and phrases. A phrase is the run of words
up to a word whose hash says so (one in PHRASE); its first LEAD_WORDS words predict the rest by how often documents to
learn from went on so, with one pseudo-count for the byte model. So a document whose like is elsewhere in the corpus costs
little, however large the corpus. A document's own phrases are never counted for itself.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import held_out, keep, small, table

END_WORD = b"\xff"  # no byte of UTF-8
SPACE = 32
PAD = b" " * 8
#: Tables (the word so far; five bytes), inputs (theirs and the match's) and gates.
CONTEXTS, INPUTS, GATES = 2, 3, 64
#: Slots of each context's table, as a power of two: so many for each byte learned from, within bounds.
SLOTS_PER_BYTE, LEAST_BITS, MOST_BITS = 2, 16, 22
SHARD = 1 << 16
#: Pairs of bytes that have a tree of their own.
PAIRS = 512
#: Values of a table's input (quarters from -31 to 31) and of the match's; cells that a gate's decisions are counted in.
LEVELS, GUESSES = 63, 3
CELLS = LEVELS * LEVELS * GUESSES * 2
#: Where weights stay that nothing is known of, and by how many decisions' worth they are held there.
FIRST_WEIGHT, HELD = 0.3, 4.0
TEXT_RATE, BINS = 0.006, 33
#: Bytes that are coded at a time, of one long text or of several short ones. Matches reach back within it.
SEGMENT, GROUP, FILL_GROUP = 1 << 17, 1 << 16, 1 << 21
#: Bytes before a later segment of a long text that its contexts may look at.
LOOK_BACK = 64
#: Blocks of a text after which its weights are renewed: 128 bytes, then twice as many up to 4096.
BOUNDS = np.concatenate([[0], np.cumsum(np.minimum(128 << np.arange(80).clip(0, 5), 4096))])
BLOCK_OF = (np.searchsorted(BOUNDS, np.arange(SEGMENT), "right") - 1).astype(np.uint16)
PHRASE, LEAD_WORDS = 32, 3
#: Words whose counts are sent to all tasks for the base score; the rest are joined. It changes no score.
HEAD_WORDS, HEAD_BITS = 1 << 18, 21
#: Distinct words that a counting task holds, and the bytes that a task that fills tables or counts decisions should read, at least.
FLUSH_WORDS, FILL_BYTES, LEARN_BYTES = 400_000, 64 << 20, 16 << 20
#: Bytes whose decisions are counted at a time, equal ones once, and of those so many.
LEARN_GROUP, LEARN_PIECE = 1 << 18, 1 << 13
SCAN_ROWS = 256
SMALL_ROWS = 200_000
M, M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
#: A hash value for each byte at each place (modulo 32) of a word.
RANDOM = np.random.default_rng(7).integers(0, 1 << 63, 256 * 32, np.uint64) * np.uint64(2) + np.uint64(1)
SCANNED = "row bigint, doc_id bigint, learned boolean, n_tokens bigint, n_bytes bigint, n_head bigint, base_head double, bits double, tail array<binary>, phrases array<struct<lead:bigint,rest:bigint,bits:float,own_lead:int,own_rest:int>>"


#: Lower case, and a space for each kind of white space.
PLAIN = bytes.maketrans(b"\t\n\v\f\r" + bytes(range(65, 91)), b" " * 5 + bytes(range(97, 123)))


def normal(text: bytes) -> bytes:
    """The lower-cased words of a text, joined by single spaces, and the end mark."""
    text = text.translate(PLAIN)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    text = text.strip(b" ")
    return text + b" " + END_WORD if text else END_WORD


def roomy() -> None:
    """Has the C library keep up to 32 MB of freed memory instead of giving it back and having it cleared anew for each array."""
    np.empty(16 << 20, np.uint8)  # it keeps twice the largest block that was mapped and freed


class Code:
    """A Huffman tree for each byte before, and for the commonest pairs before, as paths of steps (node * 2 + decision)."""

    def __init__(self, counts: dict[int, np.ndarray]):
        """counts: next bytes (256) by the pair before (two-byte numbers)."""
        singles = np.zeros((256, 256), np.int64)
        for pair, n in counts.items():
            singles[pair & 255] += n
        # after a space the word before must not matter
        inside = sorted((p for p in counts if p > 255 and p & 255 != SPACE), key=lambda p: (-int(counts[p].sum()), p))[:PAIRS]
        self.context = np.tile(np.arange(256), 256)
        self.context[inside] = 256 + np.arange(len(inside))
        #: the number of the first path of a context, by the byte before (high) and the one before that (low)
        self.first_path = (self.context.reshape(256, 256).T.ravel() << 8).astype(np.int64)
        start, length, steps, codes = [], [], [], []
        for row in [*singles, *(counts[p] for p in inside)]:
            heap = [(float(n) + 1e-3, k, k) for k, n in enumerate(row)]
            heapq.heapify(heap)
            parent, n = {}, 256
            while len(heap) > 1:
                (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
                parent[x], parent[y] = (n, 0), (n, 1)
                heapq.heappush(heap, (a + b, n, n))
                n += 1
            for k in range(256):
                path, at = [], k
                while at in parent:
                    at, bit = parent[at]
                    path.append((at - 256) * 2 + bit)
                start.append(len(steps))
                length.append(len(path))
                steps += path[::-1]
                codes.append(int("".join(str(x & 1) for x in path[::-1])[:60].ljust(60, "0"), 2))
        self.start, self.length, self.step = np.array(start, np.int32), np.array(length, np.int32), np.array(steps, np.uint16)
        #: the first 60 decisions of each path as a number
        self.code = np.array(codes, np.int64)


ROOT = 254  # of a tree with 256 leaves


def places(bits: int) -> np.ndarray:
    """What each step's node adds (by exclusive or) to a context's slot; eight neighbours share a cache line."""
    node = np.arange(512) >> 1
    return ((node >> 3) * 0x9E3779B1 << 3 & (1 << bits) - 1) | node & 7


def layout(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (lead, body) parts: all bytes, the eight bytes before each as a number (the last one highest), first places, lengths of leads."""
    joined = PAD + b"".join([x for part in parts for x in part])
    n = len(joined) - len(PAD)
    sizes = np.array([len(x) + len(y) for x, y in parts], np.int64)
    return np.frombuffer(joined, np.uint8)[len(PAD) :], np.ndarray(n, "<u8", joined, 0, (1,)).copy(), np.cumsum(sizes) - sizes, np.array([len(x) for x, _ in parts])


def words_in(b: np.ndarray, window: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where words begin, their lengths with the space after, and for each byte the hash of its word up to before it."""
    begins = (window >> np.uint64(56)) == SPACE
    begins[firsts] = True
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(b)))
    place = np.arange(len(b))
    place -= np.repeat(starts, sizes)
    place &= 31
    place <<= 8
    place |= b
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(RANDOM.take(place), out=sums[1:])
    return starts, sizes, sums[:-1] - np.repeat(sums.take(starts), sizes)


def slots(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    h = h + np.uint64(salt)
    h *= np.uint64(M)
    h ^= h >> np.uint64(29)
    h *= np.uint64(M2)
    h >>= np.uint64(64 - bits)
    return h.view(np.int64)


def running_slots(window: np.ndarray, bits: int) -> np.ndarray:
    """Slots of the context of five bytes."""
    return slots(window >> np.uint64(24), 3, bits)


def coded(code: Code, window: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of the paths that lead to the bytes b."""
    return code.first_path.take((window >> np.uint64(48)).view(np.int64)) + b


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of runs of n."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


def walked(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the steps of paths, one path after the other."""
    return _spread(start, length)


def matched(b: np.ndarray, window: np.ndarray, part: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte at the last place in the same part's body after the same six bytes, and how far to trust it (0 to 3)."""
    n = len(b)
    low = np.uint64(n.bit_length())
    key = window >> np.uint64(16)
    key *= np.uint64(M)
    key += part.view(np.uint64) * np.uint64(M2)
    key ^= key >> np.uint64(31)
    key *= np.uint64(M2)
    key >>= low
    key <<= low
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    at = (key & np.uint64((1 << int(low)) - 1)).view(np.int64)
    key >>= low
    last = np.full(n, -1)
    last[at[1:]] = np.where(key[1:] == key[:-1], at[:-1], -1)
    last = np.where(body.take(last), last, -1)
    known = last >= 0
    guess = b.take(last)
    index = np.arange(n, dtype=np.int32)
    wrong = np.maximum.accumulate(np.where(known & (guess == b) & body, np.int32(-1), index))
    run = np.zeros(n, np.int32)
    np.subtract(index[:-1], wrong[:-1], out=run[1:])
    return guess, ((run > 3).view(np.int8) + (run > 15).view(np.int8) + np.int8(1)) * known.view(np.int8)


def quantised(n: np.ndarray) -> np.ndarray:
    """A table's entries from counts of either decision: stretched probability in quarters, and confidence, in 8 bits."""
    n0, n1 = n[0::2].astype(np.float64), n[1::2].astype(np.float64)
    stretch = np.log((n1 + 0.3) / (n0 + 0.3))
    total = n0 + n1
    conf = (total > 0).astype(np.int8) + (total > 2) + (total > 30)
    return (np.clip(np.rint(stretch * 4), -31, 31).astype(np.int8) * 4 + conf).astype(np.int8)


def dealt(x: np.ndarray, counts: list[int]) -> np.ndarray:
    """What bytes that come with the longest path first have, for each of their decisions: all first decisions, all second ones, and so on."""
    return np.concatenate([x[..., :c] for c in counts], axis=-1)


def gathered(x: np.ndarray, counts: list[int]) -> np.ndarray:
    """The sums over each byte's decisions, of what dealt() has put in order."""
    out, a = x[..., : counts[0]].copy(), counts[0]
    for c in counts[1:]:
        out[..., :c] += x[..., a : a + c]
        a += c
    return out


def bits_gathered(chance: np.ndarray, counts: list[int]) -> np.ndarray:
    """The bits of each byte from the chances of its decisions in that order; the chances are multiplied first, 7 at a time."""
    bits, product, a = np.zeros(counts[0], np.float32), chance[: counts[0]].copy(), counts[0]
    for k, c in enumerate(counts[1:], 1):
        if k % 7 == 0:
            bits[:c] -= np.log(product[:c])
            product[:c] = 1
        product[:c] *= chance[a : a + c]
        a += c
    bits -= np.log(product)
    return bits * np.float32(1 / math.log(2))


def kinds(b: np.ndarray, window: np.ndarray, word: np.ndarray, guess: np.ndarray, trust: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (of those in of, or of all) of bytes that differ in what they are or are predicted from (by a hash of 64 bits), in order, and how many are like each."""
    h = window >> np.uint64(24)
    h *= np.uint64(M2)
    h += word
    h *= np.uint64(M)
    h ^= h >> np.uint64(29)
    own = trust.astype(np.uint64) << np.uint64(16)
    own |= (guess * (trust > 0)).astype(np.uint64) << np.uint64(8)
    own |= b.astype(np.uint64)
    own *= np.uint64(M2)
    h += own
    h *= np.uint64(M)
    h ^= h >> np.uint64(31)
    if of is not None:
        h = h.take(of)
    n = len(h)
    low = np.uint64(n.bit_length())
    key = h >> low
    key <<= low
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    at = (key & np.uint64((1 << int(low)) - 1)).view(np.int64)
    h = h.take(at)
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    # in the order of their places, so that what is looked up for them is read from front to back
    times = np.zeros(n, np.int64)
    times[at.take(new)] = np.diff(np.append(new, n))
    found = np.flatnonzero(times)
    return found if of is None else of.take(found), times.take(found)


class Coded:
    """The bytes of some parts with what their decisions are made from, ordered by block and then by the length of their path.

    distinct: of all blocks together, equal ones once, with how many there are.
    """

    def __init__(self, m: dict, parts: list[tuple[bytes, bytes]], distinct: bool = False):
        code, bits = m["code"], m["bits"]
        b, window, firsts, leads = layout(parts)
        starts, sizes, word = words_in(b, window, firsts)
        self.words = (starts, sizes, word)
        of_part = np.diff(np.append(firsts, len(b)))
        part = np.repeat(np.arange(len(parts)), of_part)
        at = np.arange(len(b)) - np.repeat(firsts + leads, of_part)
        guess, trust = matched(b, window, part, at >= 0)
        take = np.flatnonzero(at >= 0)
        if distinct:
            take, self.times = kinds(b, window, word, guess, trust, take)
        path = coded(code, window.take(take), b.take(take))
        length = code.length.take(path)
        # the shortest of two-byte keys are sorted fastest: a block's number is below 64, or of one part's bytes
        key = np.uint16(255) - np.minimum(length, 255).astype(np.uint16)
        if not distinct:
            key += BLOCK_OF.take(at.take(take)) * np.uint16(256)
        self.order = np.argsort(key, kind="stable")
        take, path, self.length, self.block = take.take(self.order), path.take(self.order), length.take(self.order), key.take(self.order) >> np.uint16(8)
        self.part, self.start = part.take(take), code.start.take(path).astype(np.int64)
        own, guess, trust = b.take(take), guess.take(take), trust.take(take)
        # decisions that the guess has in common with the byte: all, or those before the paths part, or none to speak of
        self.same = np.where(trust > 0, np.int16(1 << 14), np.int16(-(1 << 14)))
        wrong = np.flatnonzero((guess != own) & (trust > 0))
        other = path.take(wrong)
        apart = code.code.take(other) ^ code.code.take(other - own.take(wrong) + guess.take(wrong))
        self.same[wrong] = 60 - np.frexp(apart.astype(np.float64))[1]
        self.lines = [slots(word.take(take), 1, bits), running_slots(window.take(take), bits)]
        root = m["places"][2 * ROOT]
        # each path begins at the root, so these are the entries of all first decisions as well
        self.first = [m["tables"][k].take(self.lines[k] ^ root) for k in range(CONTEXTS)]
        self.gate = (trust * np.int8(16) + (self.first[0] & 3) * np.int8(4) + (self.first[1] & 3)).astype(np.int64)

    def decisions(self, m: dict, a: int, z: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[int]]:
        """Of the bytes from a to z, of one block: the steps, the tables' inputs for each (in quarters), whether the match is for it (1), against it (-1) or silent, and how many bytes have a first, a second ... one."""
        length = self.length[a:z]
        counts = (len(length) - np.cumsum(np.bincount(length))[:-1]).tolist()
        step = m["code"].step.take(np.concatenate([self.start[a : a + c] + k for k, c in enumerate(counts)])).astype(np.int64)
        place, found = m["places"].take(step[counts[0] :]), []
        for k in range(CONTEXTS):
            entries = np.empty(len(step), np.int8)
            entries[: counts[0]] = self.first[k][a:z]
            if counts[1:]:
                at = dealt(self.lines[k][a:z], counts[1:])
                at ^= place
                entries[counts[0] :] = m["tables"][k].take(at)
            entries >>= 2
            found.append(entries)
        left = np.concatenate([self.same[a : a + c] - np.int16(k) for k, c in enumerate(counts)])
        return step, found, (left > 0).view(np.int8) - (left == 0).view(np.int8), counts


#: A quarter with the sign of what a step decides.
QUARTER = np.where(np.arange(512) & 1, np.float32(0.25), np.float32(-0.25))


def cell(mix: np.ndarray) -> np.ndarray:
    """The bin of a mix, which is from -11.5 to 11.5."""
    return (mix * np.float32((BINS - 1) / 23) + np.float32((BINS - 1) / 2 + 0.5)).astype(np.int32)


def decided(m: dict, parts: list[tuple[bytes, bytes]], total: np.ndarray) -> None:
    """Adds to total how often each gate and inputs met each decision (GATES by CELLS, flat)."""
    c = Coded(m, parts, distinct=True)
    times, gate = c.times.take(c.order), c.gate * CELLS + (LEVELS // 2 * (LEVELS + 1) * GUESSES + 1) * 2
    for a in range(0, len(times), LEARN_PIECE):
        step, (x, y), match, counts = c.decisions(m, a, a + LEARN_PIECE)
        bit = (step & 1).astype(np.int8)
        at = dealt(gate[a : a + LEARN_PIECE], counts)
        at += np.multiply(x, np.int32(LEVELS * GUESSES * 2), dtype=np.int32)
        at += np.multiply(y, np.int16(GUESSES * 2), dtype=np.int16)
        at += match * (bit * np.int8(4) - np.int8(2)) + bit
        np.add.at(total, at, dealt(times[a : a + LEARN_PIECE], counts))


def fitted(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one gate's counted decisions (CELLS): weights, by Newton's steps to where online learning would not move them, and the map."""
    n = seen.reshape(-1, 2).astype(np.float64)
    some = np.flatnonzero(n.sum(axis=1))
    total, hits = n[some].sum(axis=1), n[some, 1]
    x = np.stack([some // (LEVELS * GUESSES) - LEVELS // 2, some // GUESSES % LEVELS - LEVELS // 2, 8 * (some % GUESSES - 1)]) / 4
    chance = lambda w: 1 / (1 + np.exp(-np.clip(w @ x, -40, 40)))
    loss = lambda w: total @ np.logaddexp(0, w @ x) - hits @ (w @ x) + HELD / 2 * ((w - FIRST_WEIGHT) ** 2).sum()
    w = np.full(INPUTS, FIRST_WEIGHT)
    now = loss(w)
    for _ in range(50):
        p = chance(w)
        step = np.linalg.solve((x * (total * p * (1 - p))) @ x.T + HELD * np.eye(INPUTS), x @ (hits - total * p) - HELD * (w - FIRST_WEIGHT))
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-7:
            step /= 2
        if then > now:
            break
        w, now = w + step, then
        if np.abs(step).max() < 1e-7:
            break
    w = np.round(w, 5)
    at = cell(np.clip(w @ x, -11.5, 11.5).astype(np.float32))
    centre = 1 / (1 + np.exp(-(np.arange(BINS) * 23 / (BINS - 1) - 11.5)))
    return w, (np.bincount(at, hits, BINS) + 4 * centre) / (np.bincount(at, total, BINS) + 4)


def bits_of(m: dict, parts: list[tuple[bytes, bytes]], own: np.ndarray) -> tuple[np.ndarray, Coded]:
    """Bits that each byte of the bodies takes, part by part. own: what each part's weights have moved by (inputs by parts), renewed here."""
    c = Coded(m, parts)
    out = np.empty(len(c.gate))
    cuts = np.flatnonzero(np.concatenate([[True], c.block[1:] != c.block[:-1]]))
    both = c.gate * own.shape[1] + c.part
    # the map for either decision, by gate, decision and a mix that is for it; and what makes the place in it
    seen = m["map"].reshape(GATES, BINS)
    seen = np.stack([1 - seen[:, ::-1], seen], axis=1).ravel()
    cells, row = np.float32((BINS - 1) / 23), c.gate.astype(np.int32) * np.int32(2 * BINS)
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(c.block)], strict=True):
        step, found, match, counts = c.decisions(m, a, z)
        # inputs with the sign of what was decided, so that all that follows is about its chance
        sign = QUARTER.take(step)
        x = np.empty((INPUTS, len(step)), np.float32)
        for k in range(CONTEXTS):
            np.multiply(found[k], sign, out=x[k])
        np.multiply(match, np.float32(2), out=x[CONTEXTS])
        # weights of the gate and of the text, by byte
        weights = (m["weights"][:, :, None] + own[:, None, :]).reshape(INPUTS, -1)
        part = dealt(np.stack([w.take(both[a:z]) for w in weights]), counts)
        part *= x
        mix = part[0]
        for k in range(1, INPUTS):
            mix += part[k]
        np.maximum(mix, np.float32(-11.5), out=mix)
        np.minimum(mix, np.float32(11.5), out=mix)
        sign *= np.float32(2 * BINS)
        sign += np.multiply(mix, cells, out=part[1])
        sign += np.float32(BINS)
        at = sign.astype(np.int32)
        at += dealt(row[a:z], counts)
        q = seen.take(at, mode="clip")
        p = np.exp(np.negative(mix, out=mix), out=mix)
        p += 1
        np.reciprocal(p, out=p)
        q += p
        q *= np.float32(0.5)
        np.maximum(q, np.float32(2e-5), out=q)
        np.minimum(q, np.float32(1 - 2e-5), out=q)
        out[a:z] = bits_gathered(q, counts)
        x *= np.subtract(np.float32(1), p, out=p)
        moved, which = gathered(x, counts), c.part[a:z]
        n = np.bincount(which, c.length[a:z], own.shape[1])
        for k in range(INPUTS):
            own[k] += np.bincount(which, moved[k], own.shape[1]) * (TEXT_RATE / (1 + n / 512))
    natural = np.empty(len(out))
    natural[c.order] = out
    return natural, c


def grouped(texts: list[bytes]) -> list[list[int]]:
    """Places of texts in groups of bounded size; texts of about the same length go together. A long one is alone."""
    out, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if not out or size + len(texts[i]) > GROUP:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(texts[i])
    return out


def segments(text: bytes) -> list[tuple[bytes, bytes]]:
    """A text in pieces of at most SEGMENT bytes, each with the bytes before it."""
    return [(text[max(0, a - LOOK_BACK) : a] or PAD, text[a : a + SEGMENT]) for a in range(0, len(text), SEGMENT)]


def phrase_rows(text: np.ndarray, hashes: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of words in the order of texts: text, hash of its beginning, hash of its rest, bits of the rest. text, hashes, cost: of each word."""
    n = len(hashes)
    cut = (hashes * np.uint64(M) >> np.uint64(33)) % np.uint64(PHRASE) == 0
    begins = np.concatenate([[True], cut[:-1] | (text[1:] != text[:-1])])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], n)
    place = np.arange(n) - np.repeat(first, last - first)
    # a word's share in the hash of the rest depends on its place
    mixed = (hashes ^ (place.astype(np.uint64) * np.uint64(M))) * np.uint64(M2)
    mixed ^= mixed >> np.uint64(29)
    rest_of = np.where(place >= LEAD_WORDS, mixed * np.uint64(M), np.uint64(0))
    spent = np.where(place >= LEAD_WORDS, cost, 0.0)
    long = last - first > LEAD_WORDS
    rest, bits = np.add.reduceat(rest_of, first)[long], np.add.reduceat(spent, first)[long]
    first, size = first[long], (last - first)[long]
    lead = np.zeros(len(first), np.uint64)
    for k in range(LEAD_WORDS):
        lead = (lead + hashes.take(first + k)) * np.uint64(M)
        lead ^= lead >> np.uint64(32)
    return text.take(first), lead.view(np.int64), (rest + size.astype(np.uint64)).view(np.int64), bits


def text_bits(m: dict, texts: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Bits of each text by the byte model, the phrases of all texts, and their words: text, hash, first byte and byte after the last."""
    out, found, words = np.zeros(len(texts)), [], []
    for group in grouped(texts):
        size = np.array([len(texts[i]) for i in group])
        if size[0] > SEGMENT:
            own, pieces = np.zeros((INPUTS, 1), np.float32), []
            for part in segments(texts[group[0]]):
                pieces.append(bits_of(m, [part], own)[0])
            bits = np.concatenate(pieces)
            b, window, firsts, _ = layout([(PAD, texts[group[0]])])
            starts, sizes, word = words_in(b, window, firsts)
        else:
            bits, c = bits_of(m, [(PAD, texts[i]) for i in group], np.zeros((INPUTS, len(group)), np.float32))
            starts, sizes, word = c.words
        # every text begins with its pad, whose spaces are empty words
        text = np.searchsorted(np.cumsum(size + len(PAD)), starts, side="right")
        at = starts - len(PAD) * (text + 1)
        begin = np.cumsum(size) - size
        real = at >= begin.take(text)
        text, at, end, sizes = text[real], at[real], (starts + sizes - 1)[real], sizes[real]
        out[group] = np.add.reduceat(bits, begin)
        # the hash of a whole word stands at the space after it; the end mark's is made of nothing
        hashes, names = word.take(end), np.array(group)
        which, *rows = phrase_rows(text, hashes, np.add.reduceat(bits, at))
        found.append((names.take(which), *rows))
        first = at - begin.take(text)
        last = first + sizes - (first + sizes < size.take(text))  # without the space, which the end mark has none of
        words.append((names.take(text), hashes, first, last))
    return out, _by_text(found, 4), _by_text(words, 4)


def _by_text(pieces: list[tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, ...]:
    if not pieces:
        return tuple(np.zeros(0, np.int64) for _ in range(n))
    columns = [np.concatenate(x) for x in zip(*pieces, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(x.take(order) for x in columns)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of whole words, as they stand in texts; the end mark's is 0."""
    b, window, firsts, _ = layout([(b" ", b" ".join(words) + b" ")])
    starts, sizes, word = words_in(b, window, firsts)
    h = word.take((starts + sizes - 1)[1:])  # the first is the empty word before the lead
    h[[w == END_WORD for w in words]] = 0
    return h


def head_table(words: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and log10(count + 0.1) of frequent words by slot; of several words for a slot the most frequent has it, the others are joined."""
    hashes, logs = np.zeros(1 << HEAD_BITS, np.uint64), np.full(1 << HEAD_BITS, np.nan)
    kept = [i for i in np.argsort(-n, kind="stable").tolist() if len(words[i]) <= 32]  # hashes tell places apart up to 32
    if kept:
        h = word_hashes([words[i] for i in kept])
        at, first = np.unique(slots(h, 5, HEAD_BITS), return_index=True)
        hashes[at], logs[at] = h.take(first), np.log10(n[np.array(kept).take(first)] + 0.1)
    return hashes, logs


def repeats_of(text: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """How often each row's text and keys occur together."""
    order = np.lexsort((*keys, text))
    new = np.zeros(len(text), bool)
    for x in (text, *keys):
        x = x.take(order)
        new[1:] |= x[1:] != x[:-1]
    group = np.cumsum(new)
    out = np.empty(len(text), np.int32)
    out[order] = np.bincount(group).take(group) if len(group) else 0
    return out


def _counted(flush: int = FLUSH_WORDS):
    """Word counts of a partition's texts (text, half), all and the second half's, of which at most so many words are held back."""

    def run(batches):
        held, n_held = [], 0

        def out():
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum"), ("n_second", "sum")])
            return pa.table({"word": t["word"], "n": t["n_sum"], "n_second": t["n_second_sum"]})

        for batch in (b.slice(a, SCAN_ROWS) for b in batches for a in range(0, b.num_rows, SCAN_ROWS)):
            texts, halves = [normal(text) for text in batch.column(0).to_pylist()], batch.column(1).to_numpy()
            words = pc.split_pattern(pa.array(texts, pa.large_binary()), b" ")
            half = np.repeat(halves, np.diff(words.offsets.to_numpy()))
            # each distinct word has a number
            found = words.values.dictionary_encode()
            number, size = found.indices.to_numpy(), len(found.dictionary)
            n, second = np.bincount(number, minlength=size), np.bincount(number[half == 1], minlength=size)
            held.append(pa.table({"word": found.dictionary.cast(pa.binary()), "n": n, "n_second": second}))
            n_held += size
            if n_held > flush:
                held = [out()]
                n_held = len(held[0])
                if n_held > flush // 2:
                    yield from held[0].combine_chunks().to_batches()
                    held, n_held = [], 0
        if held:
            yield from out().combine_chunks().to_batches()

    return run


def _word_parts(batch: pa.RecordBatch, most: int = 1 << 17):
    """Words of a batch (word and counts) in bounded runs: bytes, windows, first places and by each count how often each byte is coded."""
    words, n = batch.column(0).to_pylist(), np.stack([c.to_numpy() for c in batch.columns[1:]])
    a = size = 0
    for k, w in enumerate([*words, None]):
        if w is None or size and size + len(w) > most:
            some, times = words[a:k], n[:, a:k]
            if some:
                b, window, firsts, _ = layout([(b" ", b" ".join(some) + b" ")])
                sizes = np.array([len(x) + 1 for x in some])
                weight = np.repeat(times, sizes, axis=1)
                ends = np.array([x == END_WORD for x in some])
                weight[:, (np.cumsum(sizes) - 1)[ends]] = 0  # nothing follows an end mark
                yield b, window, np.append(firsts, 1), np.pad(weight, ((0, 0), (1, 0)))
            a, size = k, 0
        if w is not None:
            size += len(w) + 1


def _paired(batches):
    """Counts of (two bytes before, byte) inside words."""
    total: dict[int, int] = {}
    for batch in batches:
        for b, window, _, weight in _word_parts(batch):
            pair = (window >> np.uint64(56)).astype(np.int64) | (window >> np.uint64(40) & np.uint64(0xFF00)).astype(np.int64)
            joint = np.where(pair & 255 == SPACE, SPACE, pair) << 8 | b
            kinds, at = np.unique(joint, return_inverse=True)
            for k, n in zip(kinds.tolist(), np.bincount(at, weight[0]).tolist(), strict=True):
                if n:
                    total[k] = total.get(k, 0) + int(n)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["joint", "n"])


def _sharded(counts: list[np.ndarray], context: int):
    """Shards of both halves' counts as rows, compressed with their bytes sorted by place."""
    for half, c in enumerate(counts):
        for shard in range(max(1, len(c) // 2 // SHARD)):
            part = c[shard * 2 * SHARD : (shard + 1) * 2 * SHARD]
            if part.any():
                packed = _packed(part)
                columns = [pa.array([half], pa.int32()), pa.array([context * (1 << MOST_BITS) // SHARD + shard], pa.int32()), pa.array([packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["half", "shard", "counts"])


def _packed(counts: np.ndarray) -> bytes:
    """Counts (below 2 ** 63), compressed with their bytes sorted by place, the lowest first."""
    planes = np.zeros((8, len(counts)), np.uint8)
    for k in range((int(counts.max(initial=0)).bit_length() + 7) // 8):
        planes[k] = counts >> 8 * k  # what is higher is cut off
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T).view(np.int64).ravel()


def _fill_words(shared, bits: int):
    """Counts of the first context's table, from distinct words and how often they occur in either half."""

    def run(batches):
        code = shared.value
        counts, place = [np.zeros(2 << bits, np.int64) for _ in range(2)], places(bits)
        for batch in batches:
            for b, window, firsts, weight in _word_parts(batch):
                *_, word = words_in(b, window, firsts)
                path, line = coded(code, window, b), slots(word, 1, bits)
                for half in range(2):
                    some = np.flatnonzero(weight[half])
                    own = path.take(some)
                    length = code.length.take(own)
                    step = code.step.take(walked(code.start.take(own), length))
                    at = (np.repeat(line.take(some), length) ^ place.take(step)) * 2 + (step & 1)
                    np.add.at(counts[half], at, np.repeat(weight[half].take(some), length))
        yield from _sharded(counts, 0)

    return run


def _fill_texts(shared, bits: int):
    """Counts of the other table, whose context looks beyond the word, from running text (text, half): equal six bytes are counted first."""

    def run(batches):
        roomy()
        code = shared.value
        counts, place = [np.zeros(2 << bits, np.int32) for _ in range(2)], places(bits)

        def add(parts, half):
            b, window, firsts, leads = layout(parts)
            # the five bytes before and the byte itself, as one number
            six = (window >> np.uint64(24)) | (b.astype(np.uint64) << np.uint64(40))
            body = np.ones(len(b), bool)
            body[_spread(firsts, leads)] = False
            six = np.sort(six[body])
            new = np.flatnonzero(np.concatenate([[True], six[1:] != six[:-1]]))
            n, six = np.diff(np.append(new, len(six))), six.take(new)
            before = six << np.uint64(24)  # as a window
            path = coded(code, before, (six >> np.uint64(40)).astype(np.int64))
            length = code.length.take(path)
            step = code.step.take(_spread(code.start.take(path), length))
            at = np.repeat(running_slots(before, bits) * 2, length) ^ (place.take(step) * 2 + (step & 1))
            np.add.at(counts[half], at, np.repeat(n, length).astype(np.int32))

        for parts, half in _by_half(batches, FILL_GROUP):
            add(parts, half)
        yield from _sharded(counts, 1)

    return run


def _by_half(batches, most: int):
    """Groups of about so many bytes of the segments of texts (text, half) of one half, with the half."""
    held, size = [[], []], [0, 0]
    for batch in (b.slice(a, SCAN_ROWS) for b in batches for a in range(0, b.num_rows, SCAN_ROWS)):
        for text, half in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in segments(normal(text)):
                held[half].append(part)
                size[half] += len(part[1])
                if size[half] >= most:
                    yield held[half], half
                    held[half], size[half] = [], 0
    yield from ((parts, half) for half, parts in enumerate(held) if parts)


def _summed(bits: int):
    """Adds up the counts of each shard, which come sorted by shard, and quantises them."""

    def run(batches):
        shard, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pa.compress(quantised(total).tobytes(), "zstd", asbytes=True)], pa.binary())], ["shard", "entries"])
        for batch in batches:
            for k in range(batch.num_rows):
                s, c = batch.column(0)[k].as_py(), _unpacked(batch.column(1)[k].as_py(), 2 * min(SHARD, 1 << bits))
                if s != shard:
                    if shard is not None:
                        yield row()
                    shard, total = s, c
                else:
                    total += c
        if shard is not None:
            yield row()

    return run


def tables_of(shards: DataFrame, bits: int) -> list[np.ndarray]:
    """The contexts' tables; together at most CONTEXTS * 2**MOST_BITS bytes."""
    tables = [np.zeros(1 << bits, np.int8) for _ in range(CONTEXTS)]
    for x in shards.select("shard", "counts").repartition("shard").sortWithinPartitions("shard").mapInArrow(_summed(bits), "shard int, entries binary").toLocalIterator():
        context, shard = divmod(x.shard, (1 << MOST_BITS) // SHARD)
        n = min(SHARD, 1 << bits)
        tables[context][shard * n : (shard + 1) * n] = np.frombuffer(pa.decompress(x.entries, n, "zstd", asbytes=True), np.int8)
    return tables


def _decided(shared):
    """Decisions counted by gate, of texts (text, half) by the tables of the other half."""

    def run(batches):
        roomy()
        m, total = shared.value, np.zeros(GATES * CELLS, np.int64)
        for parts, half in _by_half(batches, LEARN_GROUP):
            decided(m | {"tables": m["halves"][1 - half]}, parts, total)
        for gate, seen in enumerate(total.reshape(GATES, CELLS)):
            if seen.any():
                packed = _packed(seen)
                yield pa.RecordBatch.from_arrays([pa.array([gate], pa.int32()), pa.array([packed], pa.binary())], ["gate", "counts"])

    return run


def _fitted(batches):
    """Weights and map of each gate, from its counts (gate, counts), which come sorted."""
    now, total = None, None

    def row():
        weights, chances = fitted(total)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([weights.tolist()]), pa.array([chances.tolist()])], ["gate", "weights", "map"])

    for batch in batches:
        for gate, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if gate != now and now is not None:
                yield row()
            total = _unpacked(packed, CELLS) + (total if gate == now else 0)
            now = gate
    if now is not None:
        yield row()


def mixer(docs: DataFrame, m: dict, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights to start from and the map, learned on all docs (text, half) by the tables of the halves."""
    counts = docs.coalesce(tasks).mapInArrow(_decided(docs.sparkSession.sparkContext.broadcast(m)), "gate int, counts binary")
    found = counts.repartition("gate").sortWithinPartitions("gate").mapInArrow(_fitted, "gate int, weights array<double>, map array<double>")
    weights, chances = zip(*[fitted(np.zeros(CELLS, np.int64))] * GATES, strict=True)
    weights, chances = np.array(weights).T, np.array(chances)
    for x in found.collect():  # a row for each gate
        weights[:, x.gate], chances[x.gate] = x.weights, x.map
    return weights.astype(np.float32), chances.ravel().astype(np.float32)


def _scanned(shared):
    """What a text's score needs no join for; its words outside the head with their counts; its phrases."""

    def run(batches):
        roomy()
        m = shared.value
        hashes, logs = m["head"]
        for batch in (b.slice(a, SCAN_ROWS) for b in batches for a in range(0, b.num_rows, SCAN_ROWS)):
            texts = [normal(text) for text in batch.column(1).to_pylist()]
            bits, (which, lead, rest, cost), (text, h, first, last) = text_bits(m, texts)
            n = len(texts)
            slot = slots(h, 5, HEAD_BITS)
            log = logs.take(slot)
            head = (hashes.take(slot) == h) & ~np.isnan(log)
            n_tokens, n_known = np.bincount(text, minlength=n), np.bincount(text[head], minlength=n)
            base = np.bincount(text[head], log[head], n)
            tail = np.flatnonzero(~head)
            words_out = [texts[t][a:z] for t, a, z in zip(text.take(tail).tolist(), first.take(tail).tolist(), last.take(tail).tolist(), strict=True)]
            offsets = np.searchsorted(text.take(tail), np.arange(n + 1))
            tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words_out, pa.binary()))
            phrases = pa.StructArray.from_arrays([pa.array(lead), pa.array(rest), pa.array(cost, pa.float32()), pa.array(repeats_of(which, lead), pa.int32()), pa.array(repeats_of(which, lead, rest), pa.int32())], ["lead", "rest", "bits", "own_lead", "own_rest"])
            of_text = pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(len(texts) + 1)), pa.int32()), phrases)
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(n_tokens), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_known), pa.array(base, pa.float64()), pa.array(bits), tail, of_text]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCANNED.split(", ")])

    return run


def phrase_gain(scanned: DataFrame) -> DataFrame:
    """row and gain: by how many bits the phrases of other documents to learn from shorten (or lengthen) each text."""
    all_phrases = scanned.select("row", "learned", F.explode("phrases").alias("p")).select("row", "learned", "p.*")
    # a beginning that occurs once in all documents predicts nothing for any
    leads = keep(all_phrases.groupBy("lead").agg(F.count("*").alias("n_all"), F.sum(F.col("learned").cast("bigint")).alias("n_lead")).where("n_all > 1 AND n_lead > 0").drop("n_all"), "leads")
    met = keep(all_phrases.join(small(leads, leads.count(), SMALL_ROWS), "lead"), "phrases")
    rests = met.where("learned").groupBy("lead", "rest").agg(F.count("*").alias("n_rest"))
    own = F.col("learned").cast("bigint")
    others = F.greatest(F.lit(0), F.coalesce("n_rest", F.lit(0)) - own * F.col("own_rest"))
    p = (others + F.pow(F.lit(2.0), -F.col("bits").cast("double"))) / (1 + F.col("n_lead") - own * F.col("own_lead"))
    # beyond a double's range the pseudo-count's part alone
    bits = F.when(p > 0, -F.log2(p)).otherwise(F.col("bits").cast("double") + F.log2(1 + F.col("n_lead") - own * F.col("own_lead")))
    return met.join(rests.hint("shuffle_hash"), ["lead", "rest"], "left").groupBy("row").agg(F.sum(F.col("bits").cast("double") - bits).alias("gain"))


def counted(docs: DataFrame, n: int, r: int) -> tuple[DataFrame, DataFrame, Row]:
    """Rows (row, text, doc_id, learned, half), word counts over those to learn from, and their totals."""
    learned = ~held_out(F.col("doc_id"), n, r)
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id").cast("bigint")), F.lit(2)).cast("int")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), learned.alias("learned"), half.alias("half"))
    words = keep(rows.where("learned").select("text", "half").mapInArrow(_counted(), "word binary, n bigint, n_second bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_second").alias("n_second")), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.col("n") * (F.octet_length("word") + 1)), F.lit(0)).alias("bytes")).first()
    return rows, words, total


def fit(rows: DataFrame, words: DataFrame, total: Row) -> dict:
    """The byte model: trees, tables, weights to start from and map, of what counted() returns."""
    spark = rows.sparkSession
    joint = keep(words.select("word", "n").mapInArrow(_paired, "joint int, n bigint").groupBy("joint").agg(F.sum("n").alias("n")), "joint")
    pair = F.shiftright("joint", 8)
    commonest = joint.groupBy(pair.alias("pair")).agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "pair").limit(PAIRS + 256)
    listed = joint.withColumn("pair", pair).join(F.broadcast(commonest), "pair").select("joint", "n").toArrow()  # at most 256 * (PAIRS + 256) rows
    rest = joint.withColumn("pair", pair).join(F.broadcast(commonest), "pair", "left_anti").groupBy(F.expr("joint & 65535").alias("joint")).agg(F.sum("n").alias("n")).toArrow()  # 65536 at most
    counts: dict[int, np.ndarray] = {}
    for found in (listed, rest):
        for k, c in zip(found["joint"].to_pylist(), found["n"].to_pylist(), strict=True):
            counts.setdefault(k >> 8, np.zeros(256, np.int64))[k & 255] += c
    code = Code(counts)
    bits = max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(max(1, SLOTS_PER_BYTE * total.bytes)))))
    tasks = max(1, math.ceil(total.bytes / FILL_BYTES))
    shards, trees = "half int, shard int, counts binary", spark.sparkContext.broadcast(code)
    of_words = words.select("word", F.col("n") - F.col("n_second"), "n_second").coalesce(max(1, tasks // 8)).mapInArrow(_fill_words(trees, bits), shards)
    texts = rows.where("learned").select("text", "half")
    of_halves = keep(of_words.unionByName(texts.coalesce(tasks).mapInArrow(_fill_texts(trees, bits), shards)), "shards")
    m = {"code": code, "bits": bits, "places": places(bits)}
    halves = [tables_of(of_halves.where(F.col("half") == k), bits) for k in range(2)]
    m["weights"], m["map"] = mixer(texts, m | {"halves": halves}, max(1, math.ceil(total.bytes / LEARN_BYTES)))
    m["tables"] = tables_of(of_halves, bits)
    return m


def lm_scores(docs: DataFrame, n: int = 10, r: int = 0, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document.

    Learns from rows whose crc32 of doc_id modulo n is not r; all of them teach counts, tables and mixing weights. Null and empty texts are an end mark alone. Scores are log10
    probabilities of the whole text; bits_per_byte divides by the bytes of its words and one byte after each. Rows with
    the same doc_id count and are scored each; a null doc_id is learned from. If nothing can be learned, counts are zero
    and no table knows anything. An empty table gives an empty result. head_words changes what is broadcast, not the
    result.
    """
    rows, words, total = counted(docs, n, r)
    m = fit(rows, words, total)

    # counts for the base score: the head goes to all tasks
    steps = words.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()  # 16 steps for each doubling
    least, room = None, head_words
    for x in steps:
        if (room := room - x["count"]) < 0:
            break
        least = x.step
    in_head = F.floor(F.log2("n") * 16) >= least if least is not None else F.lit(False)
    head = words.where(in_head).select("word", "n").toArrow()  # head_words rows at most
    m["head"] = head_table(head["word"].to_pylist(), head["n"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(m)
    scanned = keep(rows.select("row", "text", "doc_id", "learned").mapInArrow(_scanned(shared), SCANNED), "scanned")
    # a word that lost its slot to another is joined as well
    joined = scanned.select("row", F.explode("tail").alias("word")).join(words.hint("shuffle_hash"), "word")
    sums = joined.groupBy("row").agg(F.sum(F.log10(F.col("n") + F.lit(0.1))).alias("base_tail"), F.count("*").alias("tail_known"))
    out = scanned.withColumn("n_tail", F.size("tail")).drop("tail", "phrases").join(sums, "row", "left").join(phrase_gain(scanned), "row", "left").na.fill(0, ["base_tail", "tail_known", "gain"])
    below = math.log10(total.n + 0.1 * (total.v + 1))
    spent = F.col("bits") - F.col("gain")
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", (F.col("n_head") + F.col("tail_known")).alias("n_known"), F.lit(int(total.n)).cast("bigint").alias("train_tokens"), (F.col("base_head") + F.col("base_tail") + (F.col("n_tail") - F.col("tail_known")) * math.log10(0.1) - F.col("n_tokens") * below).alias("base_score"), (-spent * math.log10(2)).alias("score"), (spent / F.col("n_bytes")).alias("bits_per_byte"))


def op7_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
