"""SentencePiece encoding and decoding, and exact N-best segmentations.

The encoding of a text (n_pieces, ids_crc32, ids, round_trip) is that of the model's own kind as the
library gives it: for a BPE model the merges in the order of its ranks. The N best stand beside it
(best_score, best_ids_crc32, n_best, n_best_scores, n_best_pieces); in a BPE model scores are ranks, so
the best by score is mostly another segmentation than the encoding. The query gives the ids of the encoding
and of all N best, packed as little-endian 32-bit integers, and the SHA-256 of what the encoding decodes to.

A text's lattice has an edge for each piece of the model at each place where it stands; the best
segmentations are the paths of largest total score (the scores of the model file, as a unigram model
takes them). Forward Viterbi scores of all places are the exact rest cost of a search that runs
backward from the end, so A* pops only prefixes of answers and gives paths best first.

Places that no piece of the vocabulary can span cut a text into atoms whose paths are independent, and
across which a BPE model never merges. Each distinct atom is encoded, decoded and solved once by a worker
and remembered (`REMEMBERED` atoms of `REMEMBERED_CHARS` characters in all, then the memory starts
afresh). Forward scores, best path and what the next best loses are found for many atoms at once over a
trie in arrays; the search gives the N best of those atoms of a text that have the least to lose, and
the text's are merged from these.

Defined results: null or empty text has no pieces, one empty segmentation with score 0, and decodes to
""; a character without a piece is given by its UTF-8 bytes at the unknown piece's score; U+2581 in a
text is read as a blank, as by the library; ties come in the order of the search, always the same for
equal texts; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import documents, query, text_of
from .textkit import U64, lists_of, mix, pieces
from .tokens import HashTable

N_BEST = 4
#: Atoms that a worker remembers, and characters in them.
REMEMBERED, REMEMBERED_CHARS = 500_000, 16_000_000
UNKNOWN_PENALTY = 10.0
#: Longer atoms are solved one by one.
AT_ONCE = 64
BLANK = "▁"
_loaded: dict[str, Pieces] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Vocabulary, lattice and search of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library = sp
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {i: int(self.text[i][3:-1], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.special = {i for i in range(n) if sp.is_control(i)}
        self.unk = sp.unk_id()
        plain = [i for i in range(n) if i not in self.bytes and not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_unused(i)]
        self.score = {i: float(sp.get_score(i)) for i in plain}
        self.vocab = {self.text[i]: i for i in plain}
        self.longest = max(map(len, self.vocab))
        self.reach: dict[str, int] = {}  # longest piece by its first two characters
        for p in self.vocab:
            self.reach[p[:2]] = max(self.reach.get(p[:2], 1), len(p))
        self.unk_score = min(self.score.values()) - UNKNOWN_PENALTY
        letters = sorted({c for p in self.vocab for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in self.vocab:
            k = self.letter[[ord(c) for c in p]]
            self.joined[k[:-1], k[1:]] = True
        self._plant()
        self.bare = self._without_prefix(path)
        self.forget()

    @staticmethod
    def _without_prefix(path: str):
        """The library over the same model, without the blank that it puts before a text: it encodes atoms as they stand inside one."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False
        return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.used, self.chars, self.spent = 0, 0, 0
        self.ids, self.library_ids = np.zeros(1 << 20, np.uint32), np.zeros(1 << 20, np.uint32)
        self.at, self.size, self.library_at, self.library_size = (np.zeros(1 << 16, np.int64) for _ in range(4))
        self.best, self.gap, self.whole = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16, bool)
        self.deep: dict[str, list[tuple[float, list[int]]]] = {}

    def _plant(self) -> None:
        """The vocabulary as a trie: children by node and letter, and the piece that ends at each node."""
        self.letters = int(self.letter.max()) + 1
        children: dict[tuple[int, int], int] = {}
        piece = [-1]
        for text, i in self.vocab.items():
            node = 0
            for k in self.letter[[ord(c) for c in text]].tolist():
                child = children.get((node, k))
                if child is None:
                    child = children[node, k] = len(piece)
                    piece.append(-1)
                node = child
            piece[node] = i
        self.piece = np.array(piece, np.int64)
        self.children = HashTable(18)
        self.children.add(mix(np.array([n * self.letters + k + 1 for n, k in children], U64)), np.array(list(children.values()), np.int32))
        self.scores = np.zeros(max(self.vocab.values()) + 1)
        self.scores[list(self.score)] = list(self.score.values())
        self.alone = np.zeros(self.letters, bool)  # letters that are a piece of their own
        self.alone[[k for (n, k), child in children.items() if not n and piece[child] >= 0]] = True

    # one atom

    def lattice(self, atom: str) -> tuple[list[list[tuple[int, int, float]]], list[float]]:
        """Edges (start, id, score) by the place where they end, and forward Viterbi scores."""
        vocab, score, reach, n = self.vocab, self.score, self.reach, len(atom)
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        forward = [0.0] * (n + 1)
        for s in range(n):
            if s:
                forward[s] = max([forward[a] + x for a, _, x in ends[s]])
            i = vocab.get(atom[s])
            ends[s + 1].append((s, self.unk, self.unk_score) if i is None else (s, i, score[i]))
            for e in range(s + 2, min(n, s + reach.get(atom[s : s + 2], 1)) + 1):
                i = vocab.get(atom[s:e])
                if i is not None:
                    ends[e].append((s, i, score[i]))
        for edges in ends:
            edges.reverse()  # the shortest first
        if n:
            forward[n] = max([forward[a] + x for a, _, x in ends[n]])
        return ends, forward

    def search(self, atom: str, n_best: int) -> list[tuple[float, list[int]]]:
        """The n_best segmentations (score, ids), best first, by A* from the end; the rest cost is exact."""
        ends, forward = self.lattice(atom)
        # of equal totals the hypothesis nearest to its end goes first, else ties would be walked breadth first
        heap: list[tuple] = [(-forward[-1], len(atom), 0, 0.0, None)]
        found, count = [], 0
        while heap and len(found) < n_best:
            _, at, _, gained, path = heapq.heappop(heap)
            if not at:
                ids = []
                while path:
                    (start, end, i), path = path
                    ids += [i] if i != self.unk else [self.byte_id.get(b, self.unk) for b in atom[start:end].encode("utf-8", "surrogatepass")]
                found.append((gained, ids))
                continue
            for s, i, x in ends[at]:
                count += 1
                total = gained + x
                heapq.heappush(heap, (-(total + forward[s]), s, count, total, ((s, at, i), path)))
        return found

    # texts

    def atoms(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Atoms of all texts in a row, and how many each text has."""
        marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        whole = "".join(marked)
        if not whole:
            return [], np.zeros(len(texts), np.int64)
        edge = np.cumsum([len(m) for m in marked])
        code = self.letter[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cut = np.ones(len(code) + 1, bool)
        cut[1:-1] = ~self.joined[code[:-1], code[1:]]
        cut[edge] = True
        places = np.flatnonzero(cut)
        at = places.tolist()
        out = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        upto = np.searchsorted(places, edge)
        return out, np.diff(np.concatenate([[0], upto]))

    def viterbi(self, atoms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of atoms whose letters are all pieces: ids of the best paths in a row, sizes, scores, and what the next best path loses.

        A longer last piece wins a tie, as in the search. The next best path leaves the best one at some
        place, by the second best way to get there.
        """
        size = np.array([len(a) for a in atoms])
        code = self.letter[np.frombuffer("".join(atoms).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        of = np.repeat(np.arange(len(atoms)), size)
        first = np.cumsum(size) - size
        last_char = (first + size)[of]
        begin, length, piece = [], [], []
        char, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        for n in range(1, self.longest + 1):
            node = self.children.get(mix(node * self.letters + code[char + n - 1] + 1)).astype(np.int64)
            char, node = char[node >= 0], node[node >= 0]
            there = self.piece[node] >= 0
            begin.append(char[there])
            length.append(np.full(int(there.sum()), n))
            piece.append(self.piece[node[there]])
            more = char + n < last_char[char]
            char, node = char[more], node[more]
            if not len(char):
                break
        begin, length, piece = (np.concatenate(x) for x in (begin, length, piece))
        start = begin + of[begin]  # a place before each letter and one at the end of each atom
        end, depth = start + length, begin - first[of[begin]] + length
        order = np.lexsort((start, end, depth))
        start, end, depth, piece = start[order], end[order], depth[order], piece[order]
        worth = self.scores[piece]
        places = len(code) + len(atoms)
        forward, second, way = np.zeros(places), np.full(places, -np.inf), np.full(places, -1)
        edge = np.searchsorted(depth, np.arange(1, int(depth.max()) + 2))
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            value, to, at = forward[start[low:high]] + worth[low:high], end[low:high], np.arange(low, high)
            new = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            best = np.maximum.reduceat(value, new)
            count = np.diff(np.append(new, high - low))
            chosen = np.minimum.reduceat(np.where(value == np.repeat(best, count), at, high), new)
            forward[to[new]], way[to[new]] = best, chosen
            value[chosen - low] = -np.inf
            second[to[new]] = np.maximum.reduceat(value, new)
        finish = first + size + np.arange(len(atoms))
        place, gained, other, steps = finish.copy(), np.zeros(len(atoms)), np.full(len(atoms), -np.inf), np.zeros(len(atoms), np.int64)
        taken, open_ = [], np.arange(len(atoms))
        while len(open_):
            here = place[open_]
            other[open_] = np.maximum(other[open_], gained[open_] + second[here])
            e = way[here]
            taken.append((open_, piece[e]))
            gained[open_] += worth[e]
            place[open_] = start[e]
            steps[open_] += 1
            open_ = open_[start[e] > first[open_] + open_]
        ids, ends = np.zeros(int(steps.sum()), np.uint32), np.cumsum(steps)
        for n, (who, what) in enumerate(taken, 1):
            ids[ends[who] - n] = what
        return ids, steps, forward[finish], forward[finish] - other

    def _learn(self, new: list[str]) -> None:
        k, n = len(self.known), len(new)
        while k + n > len(self.at):
            for name in ("at", "size", "library_at", "library_size", "best", "gap", "whole"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        codes = self.letter[np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)]
        lengths = np.array([len(a) for a in new])
        lacking = np.concatenate([[0], np.cumsum(~self.alone[codes])])
        ends = np.cumsum(lengths)
        plain = np.flatnonzero((lengths <= AT_ONCE) & (lacking[ends] == lacking[ends - lengths]))
        paths: dict[int, tuple[float, float, list[int]]] = {}
        ids, sizes, best, gap = self.viterbi([new[i] for i in plain.tolist()]) if len(plain) else (np.zeros(0, np.uint32), *(np.zeros(0, np.int64),) * 3)
        for i in np.setdiff1d(np.arange(n), plain[gap > 1e-6]).tolist():  # ties too: the search's own order decides
            found = self.search(new[i], 2)
            paths[i] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf, found[0][1]
        cuts = np.cumsum(sizes)
        whole = [np.zeros(0, np.uint32)] * n
        for i, part, b, g in zip(plain.tolist(), np.split(ids, cuts[:-1]) if len(plain) else [], best.tolist(), gap.tolist(), strict=True):
            whole[i], self.best[k + i], self.gap[k + i] = part, b, g
        for i, (b, g, path) in paths.items():
            whole[i], self.best[k + i], self.gap[k + i] = np.array(path, np.uint32), b, g
        given = self.bare.encode([a.replace(BLANK, " ") for a in new], num_threads=1)
        self.whole[k : k + n] = [self._text(g) == a for g, a in zip(given, new, strict=True)]
        self.used = self._put("ids", "at", "size", self.used, k, whole)
        self.spent = self._put("library_ids", "library_at", "library_size", self.spent, k, given)
        self.chars += int(ends[-1])
        self.known.update(zip(new, range(k, k + n), strict=True))

    def _put(self, ids: str, at: str, size: str, used: int, k: int, lists: list) -> int:
        sizes = np.array([len(x) for x in lists])
        total = int(sizes.sum())
        while used + total > len(getattr(self, ids)):
            setattr(self, ids, np.concatenate([getattr(self, ids), np.zeros_like(getattr(self, ids))]))
        getattr(self, ids)[used : used + total] = np.concatenate([np.asarray(x, np.uint32) for x in lists])
        getattr(self, at)[k : k + len(lists)] = used + np.cumsum(sizes) - sizes
        getattr(self, size)[k : k + len(lists)] = sizes
        return used + total

    def encode(self, texts: list[str], n_best: int = N_BEST):
        """What `_encode` gives, without the last."""
        for row in self._encode(texts, n_best):
            yield row[:-1]

    def _encode(self, texts: list[str], n_best: int):
        """For each text: ids of the best path, its score, a list of (loss, changes, pieces more), best first, atoms, ids of the model's own encoding, and whether these decode to the text, and where each atom's ids begin in the best path's (one more at the end); changes is a tuple of (atom's index in the text, rank there)."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        atoms, count = self.atoms(texts)
        known = self.known
        codes = [known.get(a, -1) for a in atoms]
        if -1 in codes:
            self._learn(list(dict.fromkeys(a for a, c in zip(atoms, codes, strict=True) if c < 0)))
            codes = [known[a] for a in atoms]
        codes = np.array(codes, np.int64)
        size, best, gap, whole = self.size[codes], self.best[codes], self.gap[codes], np.concatenate([[0], np.cumsum(~self.whole[codes])])
        run = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.arange(run[-1]) + np.repeat(self.at[codes] - run[:-1], size)]
        own_size = self.library_size[codes]
        own_run = np.concatenate([[0], np.cumsum(own_size)])
        own = self.library_ids[np.arange(own_run[-1]) + np.repeat(self.library_at[codes] - own_run[:-1], own_size)]
        edge = np.concatenate([[0], np.cumsum(count)])
        for t in range(len(texts)):
            a, b = int(edge[t]), int(edge[t + 1])
            g = gap[a:b]
            few = np.argsort(g, kind="stable")[: n_best - 1] if b - a <= 64 else self._least(g, n_best - 1)
            few = [int(i) for i in few if np.isfinite(g[i])]
            yield flat[run[a] : run[b]], float(best[a:b].sum()), self._merge([(i, self._deep(atoms[a + i], n_best)) for i in few], n_best), atoms[a:b], own[own_run[a] : own_run[b]], bool(whole[a] == whole[b]), run[a : b + 1] - run[a]

    @staticmethod
    def _least(g: np.ndarray, k: int) -> np.ndarray:
        """The k smallest, ties by place."""
        if not k:
            return np.zeros(0, np.int64)
        limit = np.partition(g, min(k, len(g)) - 1)[min(k, len(g)) - 1]
        near = np.flatnonzero(g <= limit)
        return near[np.argsort(g[near], kind="stable")][:k]

    def _deep(self, atom: str, n_best: int) -> list[tuple[float, list[int]]]:
        key = atom if n_best == N_BEST else f"{n_best}\0{atom}"
        if key not in self.deep:
            self.deep[key] = self.search(atom, n_best)
        return self.deep[key]

    @staticmethod
    def _merge(choices, n_best: int) -> list[tuple[float, tuple[tuple[int, int], ...], int]]:
        """(loss, changes, pieces more than the best) of the n_best combinations, least loss first."""
        start = (0,) * len(choices)
        heap, seen, out = [(0.0, start)], {start}, []
        while heap and len(out) < n_best:
            loss, ranks = heapq.heappop(heap)
            more = sum(len(c[r][1]) - len(c[0][1]) for (_, c), r in zip(choices, ranks, strict=True))
            out.append((loss, tuple((i, r) for (i, _), r in zip(choices, ranks, strict=True) if r), more))
            for k, (_, c) in enumerate(choices):
                if ranks[k] + 1 < len(c):
                    new = (*ranks[:k], ranks[k] + 1, *ranks[k + 1 :])
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(heap, (sum(c2[0][0] - c2[r][0] for (_, c2), r in zip(choices, new, strict=True)), new))
        return out

    def spelled(self, ids: np.ndarray, changes, atoms: list[str], at: np.ndarray, n_best: int) -> np.ndarray:
        """Ids of the segmentation that differs from the best (ids, in which atoms begin `at`) by these changes."""
        parts, done = [], 0
        for i, rank in sorted(changes):
            parts += [ids[done : at[i]], np.array(self._deep(atoms[i], n_best)[rank][1], np.uint32)]
            done = at[i + 1]
        return np.concatenate([*parts, ids[done:]])

    def nbest(self, text: str, n_best: int = N_BEST) -> list[tuple[float, list[int]]]:
        """Segmentations of one text with their scores, best first."""
        for ids, score, ranked, atoms, *_, at in self._encode([text], n_best):
            return [(score - loss, self.spelled(ids, changes, atoms, at, n_best).tolist()) for loss, changes, _ in ranked]
        return []

    def _text(self, ids) -> str:
        """Pieces of ids in a row, blanks marked; bytes that are no UTF-8 become U+FFFD."""
        text = self.text
        if self.bytes.keys().isdisjoint(ids):
            return "".join([text[i] for i in ids if i not in self.special])
        parts, held = [], bytearray()
        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i not in self.special:
                parts.append(text[i])
        return "".join(parts) + held.decode("utf-8", "replace")

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return re.sub("^ ", "", self._text(ids).replace(BLANK, " "))


RESULT = "doc_id long, n_pieces long, ids_crc32 long, best_score double, best_ids_crc32 long, n_best int, n_best_scores array<double>, n_best_pieces array<long>, round_trip boolean, best_is_encoding boolean"
WITH_IDS = ", decoded_sha256 string, ids array<int>, n_best_ids array<array<int>>"
PACKED_IDS = ", decoded_sha256 string, ids binary, n_best_ids array<binary>"


def _lists(arrays: list, packed: bool) -> pa.Array:
    if packed:
        return lists_of(np.concatenate([np.zeros(0, "<u4"), *arrays]).astype("<u4"), np.array([len(a) for a in arrays], np.int64))
    flat = np.concatenate([np.zeros(0, np.uint32), *arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), pa.array(flat))


def segment(docs: DataFrame, n_best: int = N_BEST, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, packed: bool = False) -> DataFrame:
    """One row for each row of docs: size and CRC-32 (little-endian 32-bit ids) of the model's encoding, score and CRC-32 of the best segmentation, scores and sizes of the n_best, whether the encoding decodes to the text and whether the best by score is the encoding; with_ids: SHA-256 of the text that the encoding decodes to, the encoding's ids, and those of all n_best; packed: these as bytes, little-endian 32-bit integers."""
    path = model or default_model()

    def go(batches):
        own = Pieces.load(path)
        for whole in batches:
            for batch in pieces(whole):
                texts = pc.fill_null(batch.column("text"), "").to_pylist()
                n, crc, best, best_crc, found, scores, sizes, same, agree, decoded, all_ids, lists = ([] for _ in range(12))
                for ids, score, ranked, atoms, its, back, at in own._encode(texts, n_best):
                    n.append(len(its))
                    crc.append(zlib.crc32(its.astype("<u4").tobytes()))
                    best_crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    best.append(score)
                    found.append(len(ranked))
                    scores.append([score - loss for loss, _, _ in ranked])
                    sizes.append([len(ids) + more for _, _, more in ranked])
                    same.append(back)
                    agree.append(np.array_equal(its, ids))
                    if with_ids:
                        text = "".join(atoms).replace(BLANK, " ").removeprefix(" ") if back else own.decode(its.tolist())  # atoms that all decode to themselves
                        decoded.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                        all_ids.append(its)
                        lists += [own.spelled(ids, changes, atoms, at, n_best) for _, changes, _ in ranked]
                cols = {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_pieces": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "best_score": pa.array(best, pa.float64()), "best_ids_crc32": pa.array(best_crc, pa.int64()), "n_best": pa.array(found, pa.int32()), "n_best_scores": pa.array(scores, pa.list_(pa.float64())), "n_best_pieces": pa.array(sizes, pa.list_(pa.int64())), "round_trip": pa.array(same, pa.bool_()), "best_is_encoding": pa.array(agree, pa.bool_())}
                yield pa.RecordBatch.from_pydict(cols | ({"decoded_sha256": pa.array(decoded, pa.string()), "ids": _lists(all_ids, packed), "n_best_ids": pa.ListArray.from_arrays(np.cumsum([0, *found]).astype(np.int32), _lists(lists, packed))} if with_ids else {}))

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(go, RESULT + (PACKED_IDS if packed else WITH_IDS) * with_ids)


@query("op9_sentence_pieces")
def op9_sentence_pieces(spark, sf_dir):
    return segment(documents(spark, sf_dir), with_ids=True, packed=True)
