import random
import zlib

from graftline.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score string, label int"
LABELS = "doc_id long, quality int, toxic int"


def symbols(text):
    lex = toxicity.Lexicon({"fool": 2.0}, {"grumb": 1.0})
    return lex.features(text)


def test_grammar():
    plain, targeted, negated, reported, threat = range(5)
    hit = lambda t: [i for i, x in enumerate(symbols(t)) if x]
    assert hit("a fool here") == [plain]
    assert hit("you are a fool") == [targeted] and hit("you fool") == [targeted]
    assert hit("you went home and met a fool") == [plain]
    assert hit("a fool, you") == [plain, targeted] and hit("a fool came home to you") == [plain]
    assert hit("this is not a fool. well") == [negated] and hit("you are no fool") == [negated]
    assert hit("not that it would matter to a fool") == [plain]
    assert hit("somebody said fool") == [reported] and hit("he said you are a fool") == [reported]
    assert hit("somebody said so. a fool") == [plain]
    assert hit("I will kill you") == [threat] and hit("ich werde dich töten") == [threat] and hit("we are going to destroy them") == [threat]
    assert hit("they kill time") == [] and hit("kill time") == [] and hit("you will see") == []
    assert hit("stabbing is bad. killing you") == [threat] and hit("I will not kill you") == [negated]
    assert symbols("I will kill you")[threat] > symbols("kill you")[threat] > 0
    assert symbols("fool")[plain] < symbols("fool fool")[plain] < symbols("fool and fool")[plain]
    assert hit("grumbling") == [plain] and hit("grum") == []
    assert hit("") == [] and hit(None) == []


def test_composition_equals_the_machines_in_a_row():
    """Every machine over the whole output of the one before it, with the weights multiplied."""
    rng, machines = random.Random(1), lambda: (toxicity.insults(), toxicity.targets(), toxicity.threats(), toxicity.negation(), toxicity.reported())
    whole, seen = toxicity.Composition(*machines()), set()
    for _ in range(3000):
        word = [rng.randrange(8) for _ in range(rng.randrange(14))]
        out, weights = word, [1.0] * len(word)
        for machine in machines():
            state, new = 0, []
            for i, s in enumerate(out):
                state, s, w = machine.step(state, s)
                new.append(s)
                weights[i] *= w
            out = new
        assert whole.run(word) == list(zip(out, weights, strict=True))
        seen |= set(out)
    assert seen == set(range(13))


def test_machines_by_their_rules():
    """Targets and negation, said by counting words instead of states."""
    rng = random.Random(2)
    t, plain = toxicity, lambda machine, word: [s for s, _ in toxicity.Composition(machine).run(word)]
    for _ in range(2000):
        word = [rng.choice([t.OTHER, t.OTHER, t.INSULT, t.NEGATION]) for _ in range(10)]
        want = [t.NEGATED if s == t.INSULT and t.NEGATION in word[max(0, i - 3) : i] else s for i, s in enumerate(word)]
        assert plain(t.negation(), word) == want
        word = [rng.choice([t.OTHER, t.OTHER, t.INSULT, t.TARGET]) for _ in range(8)]
        out = []
        for i, s in enumerate(word):
            last = max((j for j in range(i) if word[j] in (t.TARGET, t.INSULT)), default=None)
            if s == t.INSULT and last is not None and word[last] == t.TARGET and i - last <= 3:
                s = t.ADDRESSED
            elif s == t.TARGET and last is not None and out[last] == t.INSULT and i - last <= 2:
                s = t.BACK
            out.append(s)
        assert plain(t.targets(), word) == out


def corpus(n=1500, seed=4):
    rng = random.Random(seed)
    pool = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("ra", "ne", "lo", "ti")]
    bad = ["zarkface", "blumphead"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(pool) for _ in range(rng.randrange(20, 60))]
        toxic = rng.random() < 0.15
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) if rng.random() < 0.5 else "vexu" + rng.choice(pool))
        rows.append((i, " ".join(w), "", "", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_folds(spark):
    rows, labels = corpus()
    extra = [(None, None, "", "", 0), (5000, "", "", "", 0), (5001, "zarkface " * 20000, "", "", 0), (3, rows[3][1], "", "", 0)]
    got = toxicity.score(spark.createDataFrame(rows + extra, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (4, 1, None)], LABELS)).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and not any(r.held_out for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[5000].predicted == 0 and by[None].score == by[5000].score and by[5001].predicted == 1


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert all(r.score <= 0.5 for r in toxicity.score(spark.createDataFrame(corpus(20)[0], SCHEMA), none).collect())
    assert toxicity.score(spark.createDataFrame([], SCHEMA), none).count() == 0
