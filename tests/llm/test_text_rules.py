import math
import random
import re
import time
import textwrap
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import LOWER, docs_frame, prose, words
from touchline.llm.extraction import main_text, minimum_cut, extract_pages
from touchline.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, scan_licenses
from touchline.llm.pii import PATTERNS, permute_digits, pseudonymise
from touchline.llm.quality import BUCKETS, log_ratios, ngram_counts, rate_documents, score_documents
from pyspark.sql import functions as F

GAP_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rule_texts():
    rng = random.Random(2)
    out = [None, "", " \t\n", "a", "a b c a b c a b c", "\n\n \nx y\nx y\n\nx y ", "é#*$ %&|<>", "x " * 60 + "  y"]
    for _ in range(20):
        lines = [" ".join(prose(rng, rng.randrange(0, 12), 30)) for _ in range(rng.randrange(1, 20))]
        out.append("\n".join(lines + lines[:rng.randrange(0, 3)]))
    out.append(" ".join(prose(rng, 40_000, 50)))
    return out


def expected_rules(text):
    text = text or ""
    w = words(text)
    triples = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed


def test_base_rules_equal_brute_force(spark):
    texts = rule_texts()
    got = {r.doc_id: r for r in score_documents(docs_frame(spark, texts), np.zeros(64)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected_rules(t), i
        assert r.kept == (not r.base_failed)


def pieces(text):
    """Tokens of the n-gram model: runs of one class inside words."""
    return [p for w in words((text or "").translate(LOWER)) for p in re.findall(r"[0-9a-z\u0080-\U0010ffff]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+", w)]


def ngrams(text):
    p = pieces(text)
    return p + list(zip(p, p[1:]))


def test_log_ratio_equals_brute_force(spark):
    rng = random.Random(6)
    good = [" ".join(prose(rng, 80, 40)) for _ in range(12)]
    bad = [" ".join(f"{x}%%%" for x in prose(rng, 80, 40)) for _ in range(6)]
    texts = good + bad + [None]
    frame = docs_frame(spark, texts)
    trusted = spark.createDataFrame([(i,) for i in range(8)] + [(None,), (3,)], "doc_id long")
    n = 1 << 26  # no collisions to speak of
    counts = {r.bucket: (r.raw, r.target) for r in ngram_counts(frame, trusted, n_buckets=n).collect()}
    raw, target = Counter(g for t in texts for g in ngrams(t)), Counter(g for t in texts[:8] for g in ngrams(t))
    assert sorted(counts.values()) == sorted((raw[g], target[g]) for g in raw)

    small = ngram_counts(frame, trusted)
    ratios = log_ratios(small)
    both = {r.bucket: (r.raw, r.target) for r in small.collect()}
    total = [sum(v[j] for v in both.values()) + BUCKETS for j in (0, 1)]
    for b, (r, t) in both.items():
        assert ratios[b] == pytest.approx(math.log((t + 1) / total[1]) - math.log((r + 1) / total[0]))
    scores = {r.doc_id: r.score for r in score_documents(frame, ratios).collect()}
    assert min(scores[i] for i in range(12)) > max(scores[i] for i in range(12, 18))
    assert scores[18] == 0.0


def test_held_out_accuracy(spark):
    """Labels the model did not see: junk is told from prose."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1 and toxic = 0")
    rows = rate_documents(docs, seen).join(held, "doc_id").where("not base_failed").select("quality", "kept").collect()
    right = sum(bool(r.quality) == r.kept for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.98


def test_rate_documents_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frame = docs_frame(spark, ["word " * 3, None, None], [None, 2, 2])
    rows = rate_documents(frame, labels).collect()
    assert len(rows) == 3 and all(r.score == 0 and r.base_failed and not r.kept for r in rows)
    assert rate_documents(frame.where("false"), labels).count() == 0


PERSONAL = {
    "Write to Anna.Lee+x@mail.example.com, now": ["Anna.Lee+x@mail.example.com"],
    "card 4111 1111 1111 1111.": ["4111 1111 1111 1111"],
    "order 4111111111111112 is no card": [],
    "call +1 (017) 555-7713!": ["+1 (017) 555-7713"],
    "from 97.51.17.173 and 999.1.1.1 or v1.2.3": ["97.51.17.173"],
    "born 1984-02-29, not 2023-02-30": ["1984-02-29"],
    "DE89 3704 0044 0532 0130 00 but DE88 3704 0044 0532 0130 00": ["DE89 3704 0044 0532 0130 00"],
    "ssn 123-45-6789 and 000-12-3456": ["123-45-6789"],
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"': ["04dbebab91ab85687d33eeaaf9ac699e1188f962"],
    "page 12 of 340, at 12:30": [], "": [],
    "at 2024-01-05T10:00:00Z": ["2024-01-05"], "id 2024-01-05Test": [],
    "tel 06 12 34 56 78, 01.40.20.50.50.": ["06 12 34 56 78", "01.40.20.50.50"],
    "rows 01 02 03 04 05 06": [], "v 06.12.34 56.78": [],
}


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_personal_data(spark):
    texts = list(PERSONAL) * 2 + [None]
    frame = docs_frame(spark, texts)
    rows = {r.doc_id: r for r in pseudonymise(frame, key="k", found="found").collect()}
    n = len(PERSONAL)
    for i, (text, found) in enumerate(PERSONAL.items()):
        assert rows[i].found == found
        assert all(f not in rows[i].text for f in found)
        assert (rows[i].text == text) == (not found)
        assert rows[i].text == rows[i + n].text  # equal values stay linked
    assert rows[2 * n].text is None and rows[2 * n].found == []
    card = re.search(r"card ([0-9 ]+)\.", rows[1].text).group(1)
    assert luhn(card.replace(" ", "")) and [len(p) for p in card.split()] == [4] * 4
    iban = rows[6].text[:27].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pseudonymise(frame.where("false"), key="k").count() == 0
    other = {r.doc_id: r.text for r in pseudonymise(frame, key="another").collect()}
    assert other[1] != rows[1].text
    with pytest.raises(ValueError):
        pseudonymise(frame, key="")


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_feistel_is_a_permutation(spark, width):
    n = 10 ** width
    frame = spark.range(n).select(F.lpad(F.col("id").cast("string"), width, "0").alias("d"))
    out = [r[0] for r in frame.select(permute_digits(F.col("d"), "k", "t")).collect()]
    assert len(set(out)) == n and all(len(x) == width for x in out)
    assert width < 2 or sum(x == f"{i:0{width}d}" for i, x in enumerate(out)) < n // 5


def test_dates_are_permuted_within_their_range(spark):
    frame = spark.sql("SELECT explode(sequence(date'1900-01-01', date'1930-12-31')) d").selectExpr(
        "cast(d as string) doc_id", "cast(d as string) text")
    out = [r.text for r in pseudonymise(frame, key="k").collect()]
    assert len(set(out)) == len(out) and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", x) for x in out)


def expected_license(text):
    text = (text or "").translate(LOWER)
    w = GAP_WORD.findall(text)
    places, base, more, score = [], set(), set(), 0.0
    for phrase, label in PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += here
        base |= {label} if here else set()
    sets = [(label, set(GAP_WORD.findall(t.translate(LOWER)))) for label, t in TEMPLATES]
    for line in text.split("\n"):
        have = set(GAP_WORD.findall(line))
        held = [(label, s) for label, s in sets if len(have & s) >= math.ceil(CONTAINMENT * len(s) - 1e-9)]
        for label, s in held:
            if not any(s < t for _, t in held):
                more.add(label)
                score = max(score, len(have & s) / len(s))
    return (len(w), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | more)), pytest.approx(score))


def test_licenses_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "CC BY", "cc, by CC-BY cc\nby", "all rights\treserved all rights reserved", "K cc by", "éall rights reserved"]
    texts += [t for _, t in TEMPLATES] + [t.upper() + " extra words" for _, t in TEMPLATES]
    for _ in range(30):
        w = GAP_WORD.findall(rng.choice(TEMPLATES)[1].lower())
        drop = rng.randrange(len(w))
        texts.append(" ".join(prose(rng, 5)) + "\n" + ", ".join(x for i, x in enumerate(w) if i != drop or rng.random() < 0.5))
    texts.append(" ".join(prose(rng, 20_000)) + " General Public License")
    got = {r.doc_id: r for r in scan_licenses(docs_frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == expected_license(t), t
    assert scan_licenses(docs_frame(spark, ["a"]).where("false")).count() == 0
    rows = scan_licenses(docs_frame(spark, ["CC BY", "CC BY", None], [None, None, 1])).collect()
    assert sorted(r.n_base for r in rows) == [0, 1, 1]


def test_minimum_cut_equals_exhaustive_search():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 9)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.4]

        def price(keep):
            return (sum(c for c, k in zip(costs, keep) if c > 0 and not k) - sum(c for c, k in zip(costs, keep) if c < 0 and k)
                    + sum(w for i, j, w in edges if keep[i] != keep[j]))
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert price(minimum_cut(costs, edges)) == pytest.approx(best)


def test_articles_of_the_sample_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_pages(rows).collect()}
    import html
    for r in rows.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<(?!br)[^>]*>", "", x).replace("<br>", " ")).split())
                  for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_pages_with_other_structure():
    body = "<p>First paragraph with a good many words, as an article has them in each of its parts.</p>" * 3
    page = (f"<body><div class='cookie-notice'><p>We use cookies to make this better for all of you, please accept them.</p></div>"
            f"<header><a href=/>Home</a></header><main><h1>Title</h1>{body}<div class=advert>Buy this thing now, it is great.</div>"
            f"<ul><li>One item of the list<li>Two &amp; more</ul></main><aside><p>More words beside the text that are not it.</p></aside>"
            f"<section id=comments><p>I liked this article very much, thanks for writing all of it.</p></section>"
            f"<form><p>Give us your address and more.</p><input></form><footer>&copy; x</footer><script>a<b</script></body>")
    parts = main_text(page).split("\n\n")
    assert parts[0] == "Title" and parts[-1] == "Two & more" and len(parts) == 6
    assert not any(w in main_text(page) for w in ("cookies", "Home", "Buy", "beside", "liked", "address", "©"))


@pytest.mark.parametrize("page", [None, "", "<", "<<>>", "<!-- x", "<p", "<script>x", "</p></div>", "<a" * 50, "\x00�"])
def test_broken_pages(page):
    assert isinstance(main_text(page), str)


def test_quotes_inside_unquoted_values():
    """A quote inside an unquoted value is part of it; only one behind = opens a quoted value."""
    p = "<p>Some longer paragraph of the article with enough words to be kept, number {}.</p>"
    page = "<html><body><article>" + p.format(1) + "<p>Before <a href=x title=it's>middle words that matter</a> after it, which go on for a while.</p>" \
        + p.format(2) + "<p title = \"a > b\">A value may hold a closing sign and what follows stays whole, it's so.</p></article></body></html>"
    text = main_text(page)
    assert "Before middle words that matter after it" in text and "number 2" in text and "A value may hold" in text and "b\"" not in text


@pytest.mark.parametrize("piece,end", [("<a \"", ""), ("<a \"", ">"), ("<a b=\"", ""), ("<a b=\"", ">"), ("<", ""), ("<a =", ">"), ("<!-", "")])
def test_unclosed_tags_take_linear_time(piece, end):
    t0 = time.process_time()
    main_text("<p>A paragraph.</p>" + piece * 20_000 + end)
    assert time.process_time() - t0 < 10


def test_page_edges(spark):
    frame = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 4), (None, None, "<article><p>A&nbsp; b.</p></article>", 5)],
                                  "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(frame).collect())
    assert got == [(0, "A b.", 4), (1, "", 0), (1, "", 0)]
    assert extract_pages(frame.where("false")).count() == 0


def test_patterns_compile_alone():
    assert set(PATTERNS) >= {"email", "card", "date", "phone", "ip"}


def test_addresses_at_the_end_of_a_sentence(spark):
    address = "john.d@mail.example.com"
    texts = [f"mail {address}{end}" for end in (".", ". Next", "...", ".\nNext", ". 5 more", "!", "", ".)", ". Or x@y.org.")]
    for r in pseudonymise(docs_frame(spark, texts), key="k", found="found").collect():
        end = texts[r.doc_id][5 + len(address):]
        assert r.found == [address] + ["x@y.org"] * ("x@y.org" in end)
        assert re.fullmatch("mail u[0-9a-f]{15}@example\\.invalid" + re.escape(end).replace(
            re.escape("x@y.org"), "u[0-9a-f]{15}@example\\.invalid"), r.text)


@pytest.mark.parametrize("width, sign", [(72, ""), (30, " * "), (72, "rem "), (1, "")])
def test_wrapped_notices_are_found(spark, width, sign):
    """Every template, wrapped after words of prose of any number."""
    rng = random.Random(8)
    texts, labels = [], []
    for label, template in TEMPLATES:
        for before in (0, 3, 25, 26, 27, 40, 53, 54, 55, 200):
            lines = textwrap.wrap(" ".join(prose(rng, before) + [template] + prose(rng, 60)), width, break_long_words=False)
            texts.append("\n".join(sign + x for x in lines))
            labels.append(label)
    got = {r.doc_id: r for r in scan_licenses(docs_frame(spark, texts)).collect()}
    for i, label in enumerate(labels):
        assert label in got[i].labels.split(",") and got[i].score == 1.0, texts[i]


def test_scattered_words_of_short_templates_are_no_notice(spark):
    """The words of each template, one or two to a line with prose between, spread
    over one word more than its reach."""
    rng = random.Random(9)
    texts = ["the mit group met\nunder the old license it was released to others"]
    for _, template in TEMPLATES:
        words = list(dict.fromkeys(GAP_WORD.findall(template.translate(LOWER))))
        reach = math.ceil(1.25 * len(GAP_WORD.findall(template.translate(LOWER))))
        gap = "\n".join(prose(rng, reach + 1 - len(words)))
        half = len(words) // 2
        texts.append(" ".join(words[:half]) + "\n" + gap + "\n" + " ".join(words[half:]))
    got = {r.doc_id: r for r in scan_licenses(docs_frame(spark, texts)).collect()}
    assert got[0].labels == ""
    for i, (label, _) in enumerate(TEMPLATES, 1):
        assert label not in got[i].labels.split(","), texts[i]


def test_words_far_apart_are_no_wrapped_notice(spark):
    rng = random.Random(8)
    parts = [w for x in TEMPLATES[3][1].split() for w in [x] + prose(rng, 20) + ["\n"]]
    row = scan_licenses(docs_frame(spark, [" ".join(parts)])).first()
    assert (row.labels, row.score) == ("", 0.0)


def test_values_beside_digits_and_capitals(spark):
    values = {
        "4111 1111 1111 1111 12/27": "4111 1111 1111 1111", "4111111111111111 123": "4111111111111111",
        "12 4111 1111 1111 1111": "4111 1111 1111 1111", "378282246310005 1234": "378282246310005",
        "ES9121000418450200051332 EUR 500": "ES9121000418450200051332",
        "ES91 2100 0418 4502 0005 1332 EUR 500": "ES91 2100 0418 4502 0005 1332",
        "DE89 3704 0044 0532 0130 00 BIC": "DE89 3704 0044 0532 0130 00", "AT611904300234573201 2024": "AT611904300234573201",
        "PL61109010140000071219812874 ZUS": "PL61109010140000071219812874",
        "+33 6 12 34 56 78": "+33 6 12 34 56 78", "+49 1512 3456789": "+49 1512 3456789", "+1 5551234567": "+1 5551234567",
        "+44 (0)20 7946 0958": "+44 (0)20 7946 0958", "+442079460958": "+442079460958"}
    texts = [f"see {t}, please" for t in values]
    rows = {r.doc_id: r.text for r in pseudonymise(docs_frame(spark, texts), key="k").collect()}
    for i, (text, value) in enumerate(values.items()):
        shape = re.sub("[0-9]", "#", texts[i])
        assert value not in rows[i] and re.sub("[0-9]", "#", rows[i]) == shape, text
        before, after = texts[i].split(value)
        assert rows[i].startswith(before) and rows[i].endswith(after), text
        new = rows[i][len(before):len(rows[i]) - len(after)].replace(" ", "")
        if value[0].isalpha():
            assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
        elif value[0] != "+":
            assert luhn(new)
