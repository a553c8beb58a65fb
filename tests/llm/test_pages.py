"""URL filters, HTML extraction and chat formatting against brute force."""

import collections
import html as entities
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from motorpool.llm import chat, html, urls
from motorpool.llm.queries import ORACLES
from tests.conftest import SMALL
from tests.llm.conftest import canonical

PAGES = "page_id long, url string, html string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def base_rule(url):
    host, path = split_url(url)
    fits = [(h + p, v) for h, p, v in urls.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.NET/en/", "https://example.net/en", "https://example.net?x=/en/", "http://x.net/", "http://x.net",
    "http://notnet/", "http://net/", "https://b.example.com/de/2.html?u=1#t", "https://b.example.com/DE/2", "https://o.org/fr/", "https://org/fr/x",
    "ftp://q.example.org/fr/é?z#/y", "no scheme", "://", "http://", None, "", "http://a.net:80/x://y.org/fr/", "http://É.net/a", "http://x.net/\n/en",
]


def test_base_rules_against_brute_force(spark):
    rows = list(enumerate(URLS)) + [(None, "http://a.net/"), (3, URLS[3])]
    pages = spark.createDataFrame([(i, u, "") for i, u in rows], PAGES).withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    found = urls.judge(pages, urls.base_rules(spark, urls.BASE_RULES)).select("page_id", "host", "path", "rule", "verdict")
    expected = [(i, *split_url(u), rule, verdict or "allow") for i, u in rows for rule, verdict in [base_rule(u)]]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_mined_rules_against_counts(spark):
    rnd = random.Random(1)
    examples = []
    for _ in range(400):
        tokens = sorted(t for t in "abcdef" if rnd.random() < 0.5)
        bad = "a" in tokens and "b" in tokens or rnd.random() < 0.1
        examples.append((tokens, "block" if bad else "allow"))
    df = spark.createDataFrame(examples, "tokens array<string>, label string")
    found = {(r["rule"], r["verdict"]): (r["confidence"], r["support"]) for r in urls.mine_rules(df, 0.02, 0.5).collect()}
    share = collections.Counter(label for _, label in examples)
    expected = {}
    for n in range(1, 7):
        for ante in itertools.combinations("abcdef", n):
            holding = [label for tokens, label in examples if set(ante) <= set(tokens)]
            for label in ("allow", "block"):
                hits = holding.count(label)
                if holding and hits / 400 >= 0.025 and hits / len(holding) >= 0.5:
                    expected[ante, label] = (hits / len(holding), hits / 400)
    kept = {}
    for (ante, label), (confidence, support) in expected.items():
        parents = [expected.get((tuple(x for x in ante if x != out), label), (0,))[0] if len(ante) > 1 else share[label] / 400 for out in ante]
        if all(p < confidence for p in parents):
            kept[" ".join(ante), label] = (pytest.approx(confidence), pytest.approx(support))
    assert found == kept and ("a b", "block") in found


def test_tokens_that_occur_together_are_mined_as_one(spark):
    rnd = random.Random(3)
    fields = [f"query:f{i:02}=x" for i in range(40)]
    examples = []
    for _ in range(300):
        tokens = [t for t in ("a", "b") if rnd.random() < 0.5]
        tokens += ["c", "d"] if "a" in tokens else []
        examples.append((tokens + fields * (rnd.random() < 0.3), "block" if "a" in tokens and "b" in tokens or rnd.random() < 0.2 else "allow"))
    df = spark.createDataFrame(examples, "tokens array<string>, label string")
    rules = urls.mine_rules(df, 0.02, 0.5)
    found = {(frozenset(one), r["verdict"]): r["confidence"] for r in rules.collect() for one in itertools.product(*r["alike"])}
    rates, total = {}, len(examples)
    tokens = ["a", "b", "c", "d", *fields]  # no kept rule has more than one of a class, so three tokens are the most
    for n in range(4):
        for ante in map(frozenset, itertools.combinations(tokens, n)):
            if len(ante & {"a", "c", "d"}) < 2 and len(ante & set(fields)) < 2:
                holding = [label for held, label in examples if ante <= set(held)]
                for label in ("allow", "block"):
                    rates[ante, label] = (holding.count(label) / max(1, len(holding)), holding.count(label) / total)
    kept = {}
    for (ante, label), (confidence, share) in rates.items():
        less = [rates[ante - {t}, label] for t in ante]
        if ante and confidence >= 0.5 and share * total >= 10 and all(c < confidence or (c < 0.5 and len(ante) > 1) for c, _ in less):
            kept[ante, label] = pytest.approx(confidence)
    assert found == kept and (frozenset("bd"), "block") in found
    pages = spark.createDataFrame([(1, "http://h.com/p/1.html?u=1&v=2", ""), (2, "http://h.com/q/2.html?v=2", ""), (3, "http://h.com/q/3", "")], PAGES)
    rule = [("query:u=1", "query:u=1", ["query:u=1"], "", "block", False, 0.9, 0.1, [["query:u=1", "query:v=2"]])]
    judged = urls.judge(pages, spark.createDataFrame(rule, f"{urls._RULES}, alike array<array<string>>"))
    assert {r["page_id"]: r["verdict"] for r in judged.collect()} == {1: "block", 2: "block", 3: "allow"}


def test_a_mined_rule_decides_where_no_base_rule_fits(spark):
    rules = spark.createDataFrame(
        [
            ("ending:html path:x", "path:x", ["ending:html", "path:x"], "", "block", False, 0.9, 0.1),
            ("path:x", "path:x", ["path:x"], "", "allow", False, 0.8, 0.5),
        ],
        urls._RULES,
    )
    pages = spark.createDataFrame([(1, "http://h.com/x/1.html", ""), (2, "http://h.com/x/1", ""), (3, "http://h.com/y", "")], PAGES)
    found = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in urls.judge(pages, rules).collect()}
    assert found == {1: ("block", "ending:html path:x"), 2: ("allow", "path:x"), 3: ("allow", None)}


def test_url_query_over_empty_tables(spark):
    pages, labels = spark.createDataFrame([], PAGES), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls.filter_urls(pages, labels).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/", "")], PAGES)
    assert urls.filter_urls(one, labels).first()["verdict"] == "block"


def article(parts, tail=""):
    inner = "".join(f"<{t}>{x}</{t}>" for t, x in parts)
    return (
        "<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var a='</p><article>';</script></head><body>"
        "<header><h1>The site</h1></header><nav><ul><li><a href='/a'>Menu, of many words, with marks.</a></li></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies, as everyone does, and say so at some length here.</p></div><!-- <p>not this</p> -->"
        f"<div id='main'><article>{inner}</article><section class='comments'><p>A reader says, at length, that this is all wrong.</p></section></div>"
        "<aside><p>Related, with a long and winding text, so long that it may look like an article.</p></aside>"
        f"<form><p>Write to us, please.</p></form><footer><p>&copy; us, all rights reserved, forever and ever.</p></footer>{tail}"
    )


LONG = "One sentence, with a comma. Another one; with more. " * 5


def test_html_boilerplate_goes_and_the_article_stays(spark):
    parts = [("h1", "A <i>title</i> &amp; more"), ("p", LONG), ("p", "Short."), ("h2", "Part\n  two"), ("blockquote", "Said&nbsp;so"), ("p", f"x<br>y {LONG}"), ("pre", "&lt;b&gt; &#233; &bogus; &am")]
    flat = " ".join(LONG.split())
    expected = "\n".join(["A title & more", flat, "Short.", "Part two", "Said so", f"x y {flat}", "<b> é &bogus; &am"])
    rows = [
        (1, "u", article(parts, "</body></html>")),
        (2, "u", article(parts, "<p cla")),
        (2, "u", article(parts, "<p cla")),
        (3, "u", article(parts, "<!-- open")),
        (None, None, None),
        (4, "u", ""),
        (5, "u", "<p><b>one, two.<br><p>three, four.<p>"),
        (6, "u", "<nav><p>only a menu, nothing else.</p></nav>"),
        (7, "u", "plain text, no tags at all."),
        (8, "u", "<p>" + "word, " * 60_000 + "</p>"),
        (9, "u", "<body><p a='x>y' b=\">\">in quotes, fine.</p></body>"),
    ]
    found = html.html_digest(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("article", F.lit("x"))).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert texts[1] == texts[2] == texts[3] == expected
    assert texts[None] == texts[4] == texts[6] == ""
    assert texts[5] == "one, two.\nthree, four." and texts[7] == "plain text, no tags at all."
    assert texts[8] == ("word, " * 60_000).strip() and texts[9] == "in quotes, fine."
    assert html.html_digest(spark.createDataFrame([], PAGES)).collect() == []


def test_html_of_the_source_pages(spark):
    """The generated pages hold one article of headings and paragraphs."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert found[r["page_id"]] == "\n".join(filter(None, blocks))


def paragraphs(n, first=0):
    return [f"Paragraph {i}, with a comma; and more words, as it goes. " * 3 for i in range(first, first + n)]


def texts_of(spark, pages):
    rows = [(i, "u", page) for i, page in enumerate(pages)]
    found = {r["page_id"]: r["text"].split("\n") if r["text"] else [] for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    return [found[i] for i in range(len(rows))]


def marked_up(parts):
    return "".join(f"<p>{x}</p>" for x in parts)


def flat(parts):
    return [" ".join(x.split()) for x in parts]


def test_html_keeps_title_lead_and_lesser_sections(spark):
    many, few = paragraphs(9), paragraphs(3, 9)
    links = "<div class='more'><a href='/a'>One link</a> <a href='/b'>another link</a></div>"
    pages = [
        f"<body><article><h1>Title</h1><p class='lead'>A lead.</p><div class='body'>{marked_up(many)}</div></article></body>",
        f"<body><main><h1>Title</h1><article><div class='body'>{marked_up(many)}</div></article></main>{links}</body>",
        f"<body>{links}<div id='x'><section id='a'>{marked_up(many)}</section><section id='b'>{marked_up(few)}</section></div></body>",
        f"<body><div id='one'>{many[0]}</div><div id='two'>{few[0]}</div></body>",
        f"<body><div id='one'><p>{many[0]}</p></div>{links}</body>",
        f"<body>{'<div>' * 300}{marked_up(many)}</body>",
    ]
    found = texts_of(spark, pages)
    assert found[0] == ["Title", "A lead.", *flat(many)] and found[1] == ["Title", *flat(many)]
    assert found[2] == flat(many + few) and found[3] == flat([many[0], few[0]])
    assert found[4] == flat(many[:1]) and found[5] == flat(many)


def test_html_hidden_elements_end_without_an_end_tag(spark):
    said = paragraphs(4)
    body = marked_up(said)
    rest = [
        f"<body><div><select><option>A<option>B</select></div>{body}",
        f"<body><div><select><optgroup label=x><option>A<option>B</div>{body}",
        f"<body><datalist><option>A<option>B</datalist>{body}",
        *(f"<body><{x}/>{body}" for x in ("svg", "iframe src='a'", "object", "canvas", "math", "video")),
        f"<head><meta charset='x'><title>T</title><noscript><p>none</p></noscript><body>{body}",
        f"<head><title>T</title><link rel=x>{body}",
        f"<head><title>T</title><svg><path d='M0'/></svg>{body}",
        f"<head><title>T <b>bold</b></title></head>{body}",
        f"<body><div><svg><g><path d='M0'></div>{body}",
        f"<body><div><span><iframe></span></div>{body}",
        f"<body><svg><circle r=1>{body}",
        f"<body><svg><foreignObject><p>drawn</p></foreignObject></svg>{body}",
        f"<body><div><template><div>no</div><li>no</template></div>{body}",
        f"<body><noscript><div>no</div><p>no</noscript>{body}",
        f"<body></option></select></svg>{body}",
    ]
    assert texts_of(spark, rest) == [flat(said)] * len(rest)
    head = f"<head><title>T</title>{said[0]}<p>{said[1]}"
    items = f"<body><ul><li>{said[0]}<object>no<li>{said[1]}</ul>"
    line = f"<body><p>{said[0]}<b><svg></b>{said[1]}</p>"
    assert texts_of(spark, [head, items, line]) == [flat(said[:2]), flat(said[:2]), flat([said[0] + said[1]])]


def test_html_names_of_wrappers_do_not_hide_the_article(spark):
    said, other = paragraphs(5), f"<p>{paragraphs(1, 9)[0]}</p>"
    body = marked_up(said)
    wrappers = ("class='content has-sidebar'", "class=no-sidebar", "class='with-banner'", "class='comment-enabled'", "id='share-price'")
    side = f"<div class='sidebar'>{other}</div>"
    pages = [f"<body><div {w}>{body}{side}</div></body>" for w in wrappers]
    pages += [f"<body><div {w}><article>{body}</article>{side}</div></body>" for w in wrappers]
    pages += [f"<body><div class='has-sidebar'><main><section class='with-banner'>{body}</section></main></div>{side}</body>"]
    long = f"<div class='comments'>{''.join(f'<article class=comment-body>{other}</article>' for _ in range(4))}</div>"
    pages += [f"<body><div class='no-sidebar'><article>{body}</article></div><nav class='menu'>{other * 20}</nav></body>"]
    pages += [f"<body><article>{body}</article>{long}</body>", f"<body class='has-sidebar'><div class='has-sidebar'><article>{body}</article>{long}</div></body>"]
    assert texts_of(spark, pages) == [flat(said)] * len(pages)
    assert texts_of(spark, [f"<body><p>{said[0]}</p><div class='cookie-notice'><p>short, yes.</p></div></body>"]) == [flat(said[:1])]


def test_html_reader_comments_go_and_sections_of_such_names_stay(spark):
    said = paragraphs(5)
    body, reader = marked_up(said), "<p>A reader, who disagrees, says so at length here.</p>"
    comments = [
        f"<body><main><article>{body}</article><article class='comment'>{reader}</article></main>",
        f"<body><main><article>{body}</article><article class=CommentBody>{reader * 30}</article></main>",
        *(f"<body><main><article>{body}</article><section id={name}><h2>{name}</h2>{reader}</section></main>" for name in ("responses", "discussion", "respond")),
        *(f"<body><article>{body}<div id={name}>{reader}</div></article>" for name in ("responses", "discussion", "respond", "comments")),
        f"<body><article>{body}<div id=discussion><h2>Discussion</h2><div class=c>{reader}</div><div class=c>{reader}</div></div></article>",
        f"<body><article>{body}</article><div class='comments'>{reader * 90}</div>",
        f"<body><div class=post>{body}</div><div id=comments><h2>Comments</h2>{reader}</div>",
    ]
    assert texts_of(spark, comments) == [flat(said)] * len(comments)
    short = "<p>Few words.</p>"
    sections = [
        (f"<body><article>{body}<h2 id='related-work'>Related work</h2><p>Few words.</p>", ["Related work", "Few words."]),
        (f"<body><article>{body}<section id='social-policy'><p>{said[0]}</p></section>", flat(said[:1])),
        (f"<body><article>{body}<section id=cookies><h2>Cookies</h2>{short}</section>", ["Cookies", "Few words."]),
        (f"<body><article>{body}<section id=discussion><h2>Discussion</h2>{short}</section>{marked_up(said[:1])}", ["Discussion", "Few words.", *flat(said[:1])]),
        (f"<body><main class=content>{body}<h3 id=comments>Comments</h3>{short}</main>", ["Comments", "Few words."]),
        (f"<body><article>{body}<section id='cookies'><p>We use cookies, as many do.</p></section>", []),
        (f"<body><article>{body}<div class='mysite-newsletter-box'>{short}</div>", []),
    ]
    assert texts_of(spark, [page for page, _ in sections]) == [flat(said) + more for _, more in sections]


def test_html_without_an_article_keeps_title_lead_and_last_words(spark):
    said = paragraphs(5)
    links = "<ul class=more><li><a href='/a'>One link, two</a></li><li><a href='/b'>another link.</a></li></ul>"
    pages = [
        f"<body><div id=wrap><h1>Title</h1><p class=lead>A lead</p><div class=body>{marked_up(said)}</div></div>{links}</body>",
        f"<body>{links}<div><h2>Title</h2><p>{said[0]}</p></div><div class=x><p>Ends here.</p></div></body>",
        f"<body><div class=top>My site</div><div class=body>{marked_up(said)}</div><div>Sign in</div></body>",
    ]
    found = texts_of(spark, pages)
    assert found == [["Title", "A lead", *flat(said)], ["Title", *flat(said[:1]), "Ends here."], flat(said)]


TURNS = "conv_id long, turn long, role string, text string, part long, speaker string"


def brute_chat(rows, part_turns):
    out = []
    low = lambda v: (v is not None, v if v is not None else 0)
    name = lambda v: (v is not None, (v or "").encode())
    for conv in {r[0] for r in rows} - {None}:
        turns = sorted((r[1:4] for r in rows if r[0] == conv), key=lambda r: (low(r[0]), name(r[1]), name(r[2])))
        for speaker in {r for _, r, _ in turns} - {None, "system"}:
            for part in range(0, len(turns), part_turns):
                text, mask = "", []
                for _, role, said in turns[part : part + part_turns]:
                    safe = (said or "").replace("<|", "< |") + "<|end|>"
                    who = (role if role is not None else "unknown").replace("<|", "< |")
                    head = "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user name={who}|>\n"
                    text += head
                    if role == speaker:
                        mask.append(f"{len(text)}-{len(text) + len(safe)}")
                    text += safe + "\n"
                out.append((conv, speaker, part // part_turns, len(turns[part : part + part_turns]), text, ",".join(mask)))
    return sorted(out)


def test_chat_against_brute_force(spark):
    rnd = random.Random(2)
    roles = ["user", "assistant", "Ann", None, "system", "<|odd|>"]
    rows = [(rnd.choice([1, 2, None]), rnd.choice([None, 0, 1, 2, 5]), rnd.choice(roles), rnd.choice([None, "", "hé😀", "a <|end|> b"])) for _ in range(80)]
    rows += [(3, 0, "system", "alone"), (4, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 9, "clash") for r in rows], TURNS)
    assert sorted(map(tuple, chat.rotate(df, part_turns=7).collect())) == brute_chat(rows, 7)
    assert chat.rotate(spark.createDataFrame([], TURNS)).collect() == []


def test_chat_agrees_with_sql(spark, sql):
    path = f"{SMALL}/conversations.parquet"
    assert canonical(chat.rotate(spark.read.parquet(path))) == sql({"conversations": path}, ORACLES["op6_chat_formatting"])
