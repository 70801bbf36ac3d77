import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from schemaweft.operators import grid
from schemaweft.operators.matchers import cupid, sequence, trigram
from schemaweft.operators.matchers.cupid import CupidParameters, cupid_match
from schemaweft.operators.matchers.exact import exact_match, normalized_match
from schemaweft.operators.matchers.flooding import FORMULAS, Flooding, NotConverged, Propagation, _solver, flooding_match
from schemaweft.operators.matchers.sequence import sequence_match
from schemaweft.operators.matchers.trigram import TrigramIndex, trigram_levels, trigram_match


def grams(name):
    low = name.lower()
    return {low[i : i + 3] for i in range(len(low) - 2)}


def jaccard(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def block_ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def brute_force(catalog, k, score):
    sides = {}
    for r in catalog.collect():
        sides.setdefault(r.pair_id, {"source": [], "target": []})[r.side].append((r.ordinal, r.name))
    out = {}
    for pair, both in sides.items():
        for ordinal, name in both["source"]:
            rows = sorted((-score(name, t), o, t) for o, t in both["target"])
            if rows[:k]:
                out[(pair, ordinal)] = [(t, -s) for s, _, t in rows[:k]]
    return out


def random_pairs(seed, n_pairs=25, widest=40):
    rng = random.Random(seed)

    def name():
        text = "".join(rng.choice("abAB_cé") for _ in range(rng.randint(0, 12)))
        if rng.random() < 0.3:
            text = "cust_" + text
        return text * 20 if rng.random() < 0.03 else text

    return {
        f"p{i}": [[name() for _ in range(rng.randint(1, widest))] for _ in range(2)] for i in range(n_pairs)
    }


@pytest.mark.parametrize(
    "match, src, tgt, k, expected",
    [
        (trigram_match, ["AgencyID"], ["Agency_ID", "RandomCol"], 2, [("Agency_ID", 4 / 9), ("RandomCol", 0.0)]),
        (trigram_match, ["AgencyID"], ["XYZ123", "ABC"], 5, [("XYZ123", 0.0), ("ABC", 0.0)]),
        (trigram_match, ["id"], ["identifier", "ID"], 5, [("identifier", 0.0), ("ID", 0.0)]),
        (sequence_match, ["AgencyID"], ["prospect_AgencyID", "RandomCol"], 2, [("prospect_AgencyID", 0.64), ("RandomCol", 0.352941)]),
        (sequence_match, ["AgencyID"], ["XYZ123", "ABC"], 5, [("ABC", 0.363636), ("XYZ123", 0.142857)]),
        (sequence_match, ["id"], ["identifier", "ID"], 5, [("ID", 1.0), ("identifier", 0.333333)]),
        (sequence_match, ["tide"], ["diet"], 5, [("diet", 0.25)]),
        (sequence_match, ["diet"], ["tide"], 5, [("tide", 0.5)]),
        (sequence_match, [""], [""], 5, [("", 1.0)]),
        (normalized_match, ["AgencyID"], ["Agency_ID"], 5, [("Agency_ID", 1.0)]),
    ],
)
def test_toy_names(catalog_of, ranked_lists, match, src, tgt, k, expected):
    found = ranked_lists(match(catalog_of({"p": (src, tgt)}), k))[("p", 1)]
    assert [t for t, _ in found] == [t for t, _ in expected]
    assert [s for _, s in found] == pytest.approx([s for _, s in expected], abs=1e-6)


def test_normalized_collision_takes_first_target_and_keeps_prefixes(catalog_of, ranked_lists):
    found = ranked_lists(
        normalized_match(
            catalog_of({"a": (["userid", "user_id"], ["user_id", "USERID"]), "b": (["AgencyID"], ["prospect_AgencyID"])})
        )
    )
    assert found == {("a", 1): [("user_id", 1.0)], ("a", 2): [("user_id", 1.0)]}


def test_exact_is_case_sensitive(catalog_of, ranked_lists):
    found = ranked_lists(exact_match(catalog_of({"p": (["Id", "name"], ["id", "name"])})))
    assert found == {("p", 2): [("name", 1.0)]}


@pytest.mark.parametrize("match", [exact_match, normalized_match, trigram_match, sequence_match])
def test_zero_candidates_is_abstaining(catalog_of, match):
    assert match(catalog_of({"p": (["a_b"], ["a_b"])}), k=0).count() == 0


@pytest.mark.parametrize("match, score", [(trigram_match, jaccard), (sequence_match, block_ratio)])
@pytest.mark.parametrize("k, cells", [(5, {}), (3, {"src_cell": 7, "tgt_cell": 6}), (1, {"src_cell": 1000, "tgt_cell": 9})])
def test_top_k_equals_the_full_product(catalog_of, ranked_lists, match, score, k, cells):
    catalog = catalog_of(random_pairs(k))
    if match is trigram_match:
        cells = {"cell": cells["tgt_cell"]} if cells else {}
    assert ranked_lists(match(catalog, k, **cells)) == brute_force(catalog, k, score)


def test_one_pair_holding_most_columns(catalog_of, ranked_lists):
    wide = random_pairs(9, n_pairs=1, widest=3)
    rng = random.Random(4)
    wide["hot"] = [[f"cust_{rng.randint(0, 999):03d}_{rng.choice(['nm', 'cd', 'dt'])}" for _ in range(300)] for _ in range(2)]
    catalog = catalog_of(wide)
    assert ranked_lists(trigram_match(catalog, 5, cell=40)) == brute_force(catalog, 5, jaccard)
    assert ranked_lists(sequence_match(catalog, 5, src_cell=40, tgt_cell=50)) == brute_force(catalog, 5, block_ratio)


def test_trigram_lookups_stop_at_the_bar(catalog_of):
    """Sources with close targets read a small share of the postings; none reads past its bar's prefix."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    src = [f"cust_{rng.choice(words)}_{rng.choice(words)}_name" for _ in range(120)]
    tgt = [f"{s}{i}" for s in src for i in range(5)]
    read = TrigramIndex(catalog_of({"p": (src, tgt)}), 5).lookups().collect()
    n_read, n_postings = sum(r.n_read for r in read), sum(r.n_postings for r in read)
    assert len(read) == 120 and all(r.bar > 0.8 for r in read)
    # The parts that all names share have most of the postings: they stay unread.
    assert n_read < 0.5 * n_postings
    # The whole product would visit each of the 600 targets for each of some twenty trigrams.
    assert n_read < 0.2 * 120 * 600 * 20


def test_trigram_cells_make_no_row_per_posting_and_merge_what_grows(catalog_of, monkeypatch):
    """Also with plans of many pairs, and names that are missing or too short."""
    pairs = random_pairs(12, n_pairs=12)
    pairs["odd"] = [[None, "ab", "cust_name"], ["name_cust", None, "x"]]
    catalog = catalog_of(pairs)
    monkeypatch.setattr(grid, "MANY_PAIRS", 3)
    for cell in (8192, 9):
        found = trigram_match(catalog, 3, cell=cell)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "posexplode" not in plan and "Broadcast" not in plan
        rows = {}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            rows.setdefault((r.pair_id, r.src_ord), []).append((r.tgt, r.score))
        assert rows == brute_force(catalog, 3, lambda a, b: jaccard(a or "", b or ""))


# Linguistic-structural matching against a direct computation


def token_sim(a, b, synonyms, p):
    if a == b:
        return 1.0
    best = max(synonyms.get((a, b), 0.0), synonyms.get((b, a), 0.0))
    for x, y in ((a, b), (a[::-1], b[::-1])):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        if n >= p.min_affix:
            best = max(best, n / max(len(a), len(b)))
    return best if best >= p.th_token else 0.0


def test_cupid_equals_direct_computation(spark, catalog_of):
    rng = random.Random(2)
    words = "cust customer customers addr address line id ident identity name names order ordered total".split()
    pairs = {
        f"p{i}": [
            [("_".join(rng.sample(words, rng.randint(1, 3))), rng.choice(["int", "str", "float"])) for _ in range(rng.randint(2, 25))]
            for _ in range(2)
        ]
        for i in range(12)
    }
    synonyms = {("cust", "customer"): 1.0, ("addr", "address"): 0.9}
    thesaurus = spark.createDataFrame([(a, b, v) for (a, b), v in synonyms.items()], "term string, synonym string, weight double")
    p = CupidParameters()
    compat = {("int", "float"): 0.4, ("float", "int"): 0.4}
    expected = {}
    for pair, (src, tgt) in pairs.items():
        scores = {}
        for i, (s, st) in enumerate(src):
            for j, (t, tt) in enumerate(tgt):
                a, b = s.split("_"), t.split("_")
                total = sum(max(token_sim(x, y, synonyms, p) for y in b) for x in a)
                total += sum(max(token_sim(x, y, synonyms, p) for x in a) for y in b)
                scores[i, j] = (total / (len(a) + len(b)), 0.5 if st == tt else compat.get((st, tt), 0.2))
        weigh = lambda ssim, lsim: round(p.w_struct * ssim + (1 - p.w_struct) * lsim, 9)
        strong = [ij for ij, (lsim, ssim) in scores.items() if weigh(ssim, lsim) >= p.th_accept]
        share = (len({i for i, _ in strong}) + len({j for _, j in strong})) / (len(src) + len(tgt))
        factor = p.c_inc if share > p.th_high else p.c_dec if share < p.th_low else 1.0
        for (i, j), (lsim, ssim) in scores.items():
            score = weigh(min(1.0, ssim * factor), lsim)
            if score >= p.th_accept:
                expected[pair, i + 1, j + 1] = score
    found = {
        (r.pair_id, r.src_ord, r.tgt_ord): r.score
        for r in cupid_match(catalog_of(pairs), thesaurus=thesaurus, cell=3).collect()
    }
    assert found == pytest.approx(expected) and len(expected) > 50


def test_cupid_abstains_on_abbreviations_and_rejects_an_open_threshold(catalog_of):
    catalog = catalog_of({"p": (["AgencyID", "LastName"], ["gncd", "lstnm"])})
    assert cupid_match(catalog).count() == 0
    with pytest.raises(ValueError):
        cupid_match(catalog, parameters=CupidParameters(th_accept=0.1))


def test_cupid_brings_no_columns_together_by_frequent_words(spark, catalog_of):
    letters = "bcdfghjklmnpqrstvwxz"
    middle = ["".join(x) for x in itertools.product(letters, repeat=2)][:150]
    names = [f"a_{m}{m[::-1]}{m}_with" for m in middle]
    catalog = catalog_of({"p": (names, [*reversed(names)])})
    single = catalog.select("pair_id", "side", F.col("ordinal").alias("ord"), F.explode(F.split("name", "_")).alias("token"))
    src, tgt = single.filter("side = 'source'"), single.filter("side = 'target'")
    p = CupidParameters()
    edges = cupid._edges(src, tgt, cupid.token_similarity(src, tgt, None, p))
    # Every source shares two words with every target, which is too little.
    assert cupid.meetings(src, tgt, edges, p, 4096).count() == len(names)
    assert cupid_match(catalog).count() == len(names)


def test_cupid_finds_what_looking_up_every_token_finds(catalog_of, monkeypatch):
    rng = random.Random(4)
    words = "cust customer customers addr address line id ident identity name names order ordered total q w zz".split()
    pairs = {
        f"p{i}": [["_".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 20))] for _ in range(2)] for i in range(8)
    }
    options = {"parameters": CupidParameters(th_accept=0.45), "cell": 4}
    few = sorted(map(tuple, cupid_match(catalog_of(pairs), **options).collect()))
    monkeypatch.setattr(cupid, "_looked_up", lambda s, t, p: (s[1].cast("int"), F.lit(0)))
    assert few == sorted(map(tuple, cupid_match(catalog_of(pairs), **options).collect())) and few


# Propagation against the full connectivity graph


def full_graph(src, tgt, seeds, formula, rounds):
    """Node-by-node propagation; types are given with the names."""
    cols = [(i, j) for i in range(len(src)) for j in range(len(tgt))]
    kinds = {(s[1], t[1]) for s in src for t in tgt}
    initial = {("t",): 0.0}
    initial.update({("c", *ij): 0.0 for ij in cols})
    initial.update({("n", *ij): seeds.get(ij, 0.0) for ij in cols})
    initial.update({("k", *uv): float(uv[0] == uv[1]) for uv in kinds})
    edges = []
    for i, j in cols:
        kind = ("k", src[i][1], tgt[j][1])
        members = sum((src[a][1], tgt[b][1]) == kind[1:] for a, b in cols)
        edges += [(("t",), ("c", i, j), 1 / len(cols)), (("c", i, j), ("t",), 1.0)]
        edges += [(("c", i, j), ("n", i, j), 1.0), (("n", i, j), ("c", i, j), 1.0)]
        edges += [(("c", i, j), kind, 1.0), (kind, ("c", i, j), 1 / members)]

    def flow(x):
        out = dict.fromkeys(x, 0.0)
        for a, b, weight in edges:
            out[b] += x[a] * weight
        return out

    def plus(*xs):
        return {n: sum(x[n] for x in xs) for n in xs[0]}

    state = initial
    for _ in range(rounds):
        if formula == "basic":
            new = plus(state, flow(state))
        elif formula == "a":
            new = plus(initial, flow(state))
        elif formula == "b":
            new = flow(plus(initial, state))
        else:
            new = plus(initial, state, flow(plus(initial, state)))
        top = max(new.values())
        state = {n: v / top for n, v in new.items()}
    return {ij: state[("c", *ij)] for ij in cols}


@pytest.mark.parametrize("formula", FORMULAS)
def test_flooding_equals_the_full_graph(catalog_of, ranked_lists, formula):
    src = [("cust_name", "str"), ("cust_id", "int"), ("amount", "float"), ("zz", "str")]
    tgt = [("name_cust", "str"), ("id_cust", "int"), ("amounts", "int"), ("x", "float"), ("y", "str"), ("w", "str")]
    catalog = catalog_of({"p": (src, tgt)})
    family = {"str": "text", "int": "integer", "float": "real"}
    seeds = {(i, j): jaccard(s[0], t[0]) for i, s in enumerate(src) for j, t in enumerate(tgt)}
    named = [[(n, family[t]) for n, t in side] for side in (src, tgt)]
    expected = full_graph(*named, seeds, formula, 6)
    solved = Flooding(catalog, formula=formula, max_rounds=6, epsilon=0.0)
    seen = 0
    for row in solved.shortlist().collect():
        i = row.src_ord - 1
        same = [j for j, t in enumerate(named[1]) if t[1] == row.tgt_family and seeds[i, j] == pytest.approx(row.s, abs=1e-12)]
        assert row.n_targets == len(same)
        assert [expected[i, j] for j in same] == pytest.approx([row.score] * len(same))
        assert row.tgt_ord == (None if row.s == 0 else min(same) + 1)
        seen += len(same)
    assert seen == len(expected)
    best = ranked_lists(solved.top_k(3))
    for i in range(len(src)):
        order = sorted(range(len(tgt)), key=lambda j: (-round(expected[i, j], 9), j))[:3]
        assert [t for t, _ in best[("p", i + 1)]] == [tgt[j][0] for j in order]


@pytest.mark.parametrize("cells", [{}, {"src_cell": 6, "tgt_cell": 5}])
def test_levels_sum_up_the_full_product(catalog_of, cells):
    pairs = random_pairs(11, n_pairs=12)
    rng = random.Random(5)
    typed = {p: [[(n, rng.choice(["int", "str", None])) for n in side] for side in both] for p, both in pairs.items()}
    names = {"int": "integer", "str": "text", None: "other"}
    levels, first = {}, {}
    for pair, (src, tgt) in typed.items():
        for i, (s, _) in enumerate(src):
            rows = [(names[kind], jaccard(s, t), j + 1) for j, (t, kind) in enumerate(tgt)]
            for kind, value, j in rows:
                if value > 0:
                    n, least = levels.get((pair, i + 1, kind, value), (0, j))
                    levels[pair, i + 1, kind, value] = (n + 1, min(least, j))
            for kind in names.values():
                best = sorted((-v, j) for k, v, j in rows if k == kind and v > 0)[:3]
                if best:
                    first[pair, i + 1, kind] = [j for _, j in best]
    found = trigram_levels(catalog_of(typed), 3, **cells).collect()
    assert {(r.pair_id, r.src_ord, r.family, r.s): (r.n, r.tgt_ord) for r in found if r.n} == levels
    got = {}
    for r in sorted((r for r in found if not r.n), key=lambda r: (-r.s, r.tgt_ord)):
        got.setdefault((r.pair_id, r.src_ord, r.family), []).append(r.tgt_ord)
    # Every chunk sends its first three; the first of all are among them, in order.
    assert {key: rows[:3] for key, rows in got.items()} == first


@pytest.mark.parametrize("dense", [1, 32, 10**9])
def test_levels_of_a_source_equal_direct_computation(monkeypatch, dense):
    monkeypatch.setattr(trigram, "DENSE", dense)
    rng = random.Random(6)
    names = ["".join(rng.choices("abc_𝄞", k=rng.randint(0, 12))) for _ in range(300)]
    ordinals, families = np.array(rng.sample(range(10**12), len(names))), [rng.choice("xyz") for _ in names]
    index = trigram.LevelIndex(ordinals, names, families)
    for text in [*names[:40], "", None, "qqqq", "abcabcabc" * 40]:
        scores = sorted((f, -jaccard(text or "", t), o) for t, o, f in zip(names, ordinals.tolist(), families) if jaccard(text or "", t))
        found = index.of(text, 3, True)
        if not scores:
            assert found is None
            continue
        levels = {key: [o for *_, o in rows] for key, rows in itertools.groupby(scores, lambda x: x[:2])}
        own = ordinals[index.rows]
        assert {(index.families[f], -s): (n, own[t]) for f, s, n, t in zip(*found[0])} == {k: (len(v), v[0]) for k, v in levels.items()}
        first = [row for _, rows in itertools.groupby(scores, lambda x: x[0]) for row in itertools.islice(rows, 3)]
        assert [(index.families[f], -s, own[t]) for f, s, t in zip(*found[1])] == first
        for f, n, total, squares, most in zip(*found[2]):
            of_family = [-s for kind, s, _ in scores if kind == index.families[f]]
            assert (n, most) == (len(of_family), max(of_family))
            assert (total, squares) == pytest.approx((sum(of_family), sum(x * x for x in of_family)))


def test_flooding_keeps_one_row_a_source_and_lists_levels_only_if_asked(catalog_of):
    catalog = catalog_of(random_pairs(9, n_pairs=3, widest=12))
    whole, cut, few = Flooding(catalog), Flooding(catalog, src_cell=4, tgt_cell=3), Flooding(catalog, whole=False)
    assert whole.found.count() == cut.found.count() == catalog.filter("side = 'source'").count()
    ranked = [sorted(f.top_k(5).withColumn("score", F.round("score", 9)).collect()) for f in (whole, cut, few)]
    assert ranked[0] == ranked[1] == ranked[2] and ranked[0]
    listed = [sorted(f.shortlist().select("pair_id", "src_ord", "tgt_family", "s", "n_targets", F.coalesce("tgt_ord", F.lit(0))).collect()) for f in (whole, cut)]
    assert listed[0] == listed[1]
    assert few.found.filter(F.size("levels") > 0).count() == 0
    with pytest.raises(ValueError, match="whole ranking"):
        few.shortlist()


def test_flooding_with_given_similarities_and_rounds_that_end_early(spark, catalog_of, ranked_lists):
    catalog = catalog_of(random_pairs(8, n_pairs=3, widest=9))
    seeds = trigram_match(catalog, 9)
    own, given = Flooding(catalog, k=4), Flooding(catalog, seeds=seeds, k=4)
    rounded = [{key: [(t, round(s, 9)) for t, s in rows] for key, rows in ranked_lists(f.top_k(4)).items()} for f in (own, given)]
    assert rounded[0] == rounded[1]
    with pytest.raises(ValueError, match="first 4"):
        own.top_k(5)
    with pytest.raises(NotConverged):
        Flooding(catalog, max_rounds=2)


def test_flooding_converges_and_never_abstains(catalog_of):
    catalog = catalog_of(random_pairs(3, n_pairs=4, widest=8))
    rounds = {r.pair_id: (r.rounds, r.residual) for r in Flooding(catalog).classes.collect()}
    assert all(n < 100 and residual <= 1e-6 for n, residual in rounds.values())
    sources = catalog.filter("side = 'source'").count()
    assert flooding_match(catalog, 1).count() == sources


def test_flooding_of_a_wide_pair_goes_on_until_it_rests():
    """1,600 columns a side need more than a thousand rounds; the state is then its own successor."""
    kinds = [(a, b) for a in ("real", "text") for b in ("real", "text")]
    sides = {"n_src": [400, 400, 1200, 1200], "n_tgt": [900, 700, 900, 700]}
    sums = {"s_sum": [9e3, 8e3, 3e4, 4e4], "s_squares": [900.0, 800.0, 4e3, 6e3], "s_max": [1.0, 0.8, 0.9, 1.0]}
    classes = pd.DataFrame({"pair_id": "p", **dict(zip(("src_family", "tgt_family"), map(list, zip(*kinds)))), **sides, **sums})
    solved = _solver("c", None, 1e-6)(classes)
    assert solved["converged"].all() and solved["rounds"].iloc[0] > 1000
    assert not _solver("c", 1000, 1e-6)(classes)["converged"].any()
    graph, state = Propagation(classes), Propagation(classes).initial
    for _ in range(solved["rounds"].iloc[0]):
        state = graph.step(state, "c")
    assert solved["alpha"].iloc[0] == state[0] and graph.distance(graph.step(state, "c"), state) <= 1e-6


def test_flooding_that_never_rests_ends():
    """The residual of a pair that cannot reach an epsilon below its noise finds no new least value."""
    classes = pd.DataFrame(
        {"pair_id": ["p"], "src_family": ["text"], "tgt_family": ["text"], "n_src": [30], "n_tgt": [30], "s_sum": [70.0], "s_squares": [9.0], "s_max": [0.7]}
    )
    solved = _solver("c", None, 1e-300)(classes)
    assert solved["converged"].all() or solved["rounds"].iloc[0] < 100_000


def test_block_ratio_is_that_of_the_standard_library():
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abc\u00e9_") for _ in range(draw.randrange(n)))
    for n in [24] * 2000 + [240] * 20:
        a, b = text(n), text(n)
        assert sequence.block_ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_subsequences_are_sought_only_where_common_characters_reach_the_bar(monkeypatch):
    sought = []

    class Counting(sequence.SubsequenceBound):
        def of(self, text, at=None):
            sought.append(len(self.lengths) if at is None else len(at))
            return super().of(text, at)

    monkeypatch.setattr(sequence, "SubsequenceBound", Counting)
    texts = ["order_date", "date_order", "xyz", "zzzzzzzzzz", "", "order_date_2"]
    (_, best), = sequence._by_matching_blocks(texts, list(range(6)), {"order_date": 0.7}, 2)
    assert sorted(best) == [(0, 1.0), (5, 20 / 22)] and sought == [3]
    # More kinds of characters than there are bits.
    many = ["".join(map(chr, range(300 + i, 500 + i))) for i in range(8)]
    bound = sequence.CharacterBound(many)
    assert all(n >= len(set(many[3]) & set(t)) for n, t in zip(bound.of(many[3]), many))


@pytest.mark.parametrize("spare", [1, 4])
def test_trigrams_over_a_bar_skip_the_longest_postings(monkeypatch, spare):
    """First targets over a bar equal plain scoring; the trigram that all targets hold is not read."""
    draw = random.Random(7)
    texts = list({"xyz" + "".join(draw.choice("abcd") for _ in range(draw.choice([0, 1, 5, 9, 14]))) for _ in range(300)})
    firsts = draw.sample(range(1000), len(texts))
    sources = {"xyz" + "".join(draw.choice("abcd") for _ in range(9)): draw.choice([0.2, 1 / 3, 0.5, 1.0]) for _ in range(100)}
    sources |= {texts[0]: 1.0, "": 0.5, "qqqq": 0.1, "".join(draw.choice("abcdefghijklmnop") for _ in range(900)): 0.9}
    monkeypatch.setattr(trigram, "SPARE", spare)
    read, concatenate = [], np.concatenate
    monkeypatch.setattr(np, "concatenate", lambda parts, *a, **k: (read.extend(map(len, parts)), concatenate(parts, *a, **k))[1])
    got = dict(trigram._by_shared_grams(texts, firsts, sources, 5))
    monkeypatch.undo()
    if spare == 1:
        assert read and max(read) < len(texts)
    assert set(got) == set(sources)
    for source, bar in sources.items():
        a, want = trigram._grams(source), []
        for i, text in enumerate(texts):
            b = trigram._grams(text)
            score = len(a & b) / len(a | b) if a & b else 0.0
            if score >= bar:
                want.append((-score, firsts[i], i))
        assert got[source] == [(i, -s) for s, _, i in sorted(want)[:5]]
