"""Markdown and MDX pages: what stays, what goes, and under which heading."""

import pytest

from findspar.sources import markdown


def parsed(text, title="t"):
    return [(s["heading"], s["text"]) for s in markdown.parse(text, title)]


def body(text):
    return "\n".join(t for _, t in parsed(text))


def test_headings_nest_and_empty_sections_go():
    assert parsed("# Guide\n\nintro\n\n## Trouble\n\n### Error X\n\nfix it\n## Other\nx") == [("Guide", "intro"), ("Guide > Trouble > Error X", "fix it"), ("Guide > Other", "x")]
    assert parsed("words\n#nothing\n####### seven\n") == [("t", "words\n#nothing\n####### seven")]
    assert parsed("# A {#a}\nx\n# `code` **b**\ny") == [("A", "x"), ("code b", "y")]
    assert parsed("") == [] and parsed("# only\n## headings") == []


def test_front_matter():
    page = "---\ntitle: \"Secrets\"\nkind: x\n---\n# Secrets\nIntro.\n## Types {#types}\nOpaque.\n"
    assert parsed(page) == [("Secrets", "Intro."), ("Secrets > Types", "Opaque.")]
    assert parsed("---\nkind: x\n---\nA\n") == [("t", "A")]
    assert parsed("---\ntitle: open\nA\n")[0][1].startswith("---")


@pytest.mark.parametrize(("mark", "inside"), [("```", "# no heading\n<b>kept</b>\n    port: 1"), ("~~~", "```\n# still code\n```"), ("````", "```\nx\n```"), ("```", "<!-- example -->\n<CalloutBox title=\"Example\">x</CalloutBox>")])
def test_fenced_code_stays_as_it_is(mark, inside):
    assert parsed(f"# G\n\n{mark}lang\n{inside}\n{mark}\n## R\nx") == [("G", inside), ("G > R", "x")]


def test_a_fence_that_never_closes_holds_the_rest():
    assert parsed("# G\n```\na\n# b") == [("G", "a\n# b")]


def test_comments():
    page = "# T\n\n<!-- body -->\nKeep this.\nAlso <!-- TODO: fix -->this.\n<!-- a\nmulti-line\nnote -->\nAfter.\n\n```html\n<!-- example -->\n```\n"
    assert parsed(page) == [("T", "Keep this.\nAlso this.\nAfter.\n\n<!-- example -->")]
    # a comment around a fence, a fence around a comment's start, and one that never closes
    assert body("<!-- a\n```\ncode\n```\nb -->\nafter") == "after"
    assert body("```\n<!-- a\n```\nb -->\nafter") == "<!-- a\nb -->\nafter"
    assert body("x <!-- open\n```\ny\n```\n") == "x"


def test_inline_code_is_opaque():
    page = "Write `<!-- note -->` or ``a `<!--` b`` to comment. <!-- real -->Done.\nUnclosed ` tick <!-- gone -->ok.\n`**x**` and `<Caption>` and [`y`](u)."
    assert body(page) == "Write <!-- note --> or a `<!--` b to comment. Done.\nUnclosed ` tick ok.\n**x** and <Caption> and y."


def test_inline_marks():
    assert body("See the [IT portal](https://x) for *details*.") == "See the IT portal for details."
    assert body("ERR_TUNNEL_4012 and max_retry_count; 3 * 4 * 5") == "ERR_TUNNEL_4012 and max_retry_count; 3 * 4 * 5"
    assert body("- **Step 1**: run `x --y`\n  * two\n+ three\n> quoted *it*\n> - item") == "- Step 1: run x --y\n- two\n- three\nquoted it\n- item"
    assert body("![alt](p.png) [![badge](b)](u) [] [a][b] [c](") == "alt badge [] [a][b] [c]("
    assert body("**bold *both* end** *a* b*c *open") == "bold both end a b*c *open"


def test_shortcodes_are_words_everywhere():
    page = (
        "On a {{< glossary_tooltip text=\"node\" term_id=\"node\" >}} with a {{< glossary_tooltip term_id=\"container-runtime\" >}}.\n{{< note >}}\nCareful.\n{{< /note >}}\n"
        "{{< feature-state feature_gate_name=\"RestartRules\" >}}\n{{< feature-state for_k8s_version=\"v1\" state=\"beta\" >}}\n{{% code_sample file=\"pods/x.yaml\" %}}\n"
        "Version {{< param \"version\" >}} ok. {{ x }}\n```\n{{< warning >}}\n```\n## {{% heading \"whatsnext\" %}}\n\nRead more.\n"
    )
    assert parsed(page) == [("t", "On a node with a container runtime.\nNote:\nCareful.\n\nFeature gate: RestartRules\nFeature state: beta v1\n(example file: pods/x.yaml)\nVersion ok. {{ x }}\nWarning:"), ("What's next", "Read more.")]


def test_components_give_their_words():
    page = (
        "import { C } from 'a/b'\nimport S from './s.mdx'\n\n{/* editors: keep\nthis */}\nAsk <TeamMember name=\"Lottie Coxon\" photo /> or the <SmallTeam slug=\"people\" />.\n\n"
        "<CalloutBox icon=\"i\" title=\"Book it\" type=\"fyi\">\nUse <PrivateLink url=\"https://x\">Slack</PrivateLink>.\n</CalloutBox>\n\n<Shot\n  light=\"l.png\"\n  dark=\"d.png\"\n/>\n<SOC2 />\n"
        "<details><summary>Leave</summary>\n<p><strong>M:</strong> 24 weeks<br />\n<strong>P:</strong> 6</p>\n</details>\n"
    )
    assert body(page) == "Ask Lottie Coxon or the people team.\n\nBook it\n\nUse Slack.\n\nLeave\n\nM: 24 weeks\n\nP: 6"


def test_placeholders_stay():
    for line in ("kubectl cp <source> <dest>", "Pick a <table> name and a <code> value", "Press <b> then <a>.", "Replace <NAME>; run <name-of-pod>; see <https://example.com>; 1 < 2 > 0"):
        assert body(line) == line
    assert body('One<br>two, <b>bold</b>, <a href="x">link</a>, <a id="y" />end') == "One\ntwo, bold, link, end"
    # closed elsewhere on the page, around a fence too
    assert body("<Multi>\n\n```js\nx\n```\n\n</Multi>\n<Tab.Panel>\ny\n</Tab.Panel>") == "x\n\ny"
    assert body("Press <b> now.\n\n</b>") == "Press now."


def test_import_in_prose_is_prose():
    assert body("import taxes rise\n\nfrom 'abroad'") == "import taxes rise\n\nfrom 'abroad'"
