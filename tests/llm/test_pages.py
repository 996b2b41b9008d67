"""Main text of hand-labelled pages: what stands in double braces is main text, everything else is not."""

import html as entities
import re

import pytest

from tallyaudit.llm import html

NAV = '<nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = '<footer><p>© 2023 Harbour Media. All rights reserved.</p><a href="/terms">Terms</a> <a href="/privacy">Privacy policy</a></footer>'
P1 = "{{The council met on Tuesday evening to discuss the new bridge, and after three hours of debate it agreed to fund the first part of the work.}}"
P2 = "{{Residents had asked for a crossing near the old mill since the flood of last spring, when the road was closed for almost two weeks.}}"
P3 = "{{Work is expected to begin in autumn, once the ground has been surveyed and the remaining permits have been issued by the province.}}"
SHORT = "{{Nobody objected.}}"

PAGES = {
    "article": f"<html><head><title>Site</title></head><body>{NAV}<article><h1>{{{{Council funds a bridge}}}}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></article>{FOOT}</body></html>",
    "main element": f"<body><header><a href='/'>Harbour News</a></header>{NAV}<main><h1>{{{{Council funds a bridge}}}}</h1><p>{P1}</p><p>{SHORT}</p><p>{P3}</p></main>{FOOT}",
    "plain divs": f"<body><div class='topbar'><a href='/'>Home</a> <a href='/x'>Shop</a></div><div class='content'><h2>{{{{A crossing at last}}}}</h2><div>{P1}</div><div>{P2}</div></div><div class='footer'>© 2022 Mill Press</div>",
    "no classes": f"<body>{NAV}<div><h1>{{{{A crossing at last}}}}</h1><p>{P2}</p><p>{P3}</p></div>{FOOT}",
    "comments inside": f"<body>{NAV}<article><h1>{{{{Council funds a bridge}}}}</h1><p>{P1}</p><p>{P2}</p><section class='comments'><h3>2 comments</h3><div class='comment'><b>anna</b><p>Great news for all of us who drive there every day!</p></div><div class='comment'><p>About time, I would say.</p></div></section></article>{FOOT}",
    "comments after": f"<body><article><p>{P1}</p><p>{P3}</p></article><div id='comments'><h2>Comments</h2><ul><li class='comment'>I do not believe a word of it.</li><li class='comment'>Who pays for this, and when will we see the bill?</li></ul><form><label>Your name</label><input><button>Post</button></form></div>{FOOT}",
    "sidebar": f"<body>{NAV}<div class='content'><p>{P1}</p><p>{P2}</p></div><aside class='sidebar'><h3>Popular</h3><ul><li><a href='/1'>Ten walks along the coast</a></li><li><a href='/2'>How to bake bread</a></li></ul></aside>{FOOT}",
    "sidebar first": f"<body><div class='sidebar'><h4>Archive</h4><ul><li><a href='/a'>May</a></li><li><a href='/b'>June</a></li></ul></div><article><h1>{{{{Council funds a bridge}}}}</h1><p>{P2}</p><p>{P1}</p></article>",
    "cookie notice": f"<body><div class='cookie-banner'><p>We use cookies to improve your visit. By continuing you accept our privacy policy.</p><button>Accept</button></div><article><p>{P1}</p><p>{P2}</p></article>{FOOT}",
    "advert between": f"<body><article><p>{P1}</p><div class='ad'><p>Advertisement: save 20% on garden chairs this week only!</p></div><p>{P2}</p><p>{P3}</p></article>{FOOT}",
    "newsletter": f"<body>{NAV}<article><p>{P2}</p><p>{P3}</p></article><form class='newsletter'><p>Subscribe to our newsletter and never miss a story.</p><input type='email'><button>Sign up</button></form>{FOOT}",
    "related": f"<body><article><h1>{{{{Council funds a bridge}}}}</h1><p>{P1}</p><p>{P2}</p></article><div class='related'><h3>Related stories</h3><ul><li><a href='/1'>Mill opens its doors</a></li><li><a href='/2'>Flood damage repaired</a></li></ul></div>",
    "share bar": f"<body><article><h1>{{{{A crossing at last}}}}</h1><div class='share'><a href='#'>Share</a> <a href='#'>Tweet</a></div><p>{P1}</p><p>{P2}</p></article>{FOOT}",
    "list in the text": f"<body>{NAV}<article><p>{P1}</p><ul><li>{{{{The first part covers the two towers on the northern bank.}}}}</li><li>{{{{The second part covers the roadway and the lights.}}}}</li></ul><p>{P3}</p></article>{FOOT}",
    "numbered steps": f"<body><main><h1>{{{{How to oil a hinge}}}}</h1><ol><li>{{{{Lift the door off and lay it on two trestles.}}}}</li><li>{{{{Clean the pin with a dry cloth.}}}}</li><li>{{{{Put one drop of oil on the pin and hang the door again.}}}}</li></ol></main>{FOOT}",
    "data table": f"<body>{NAV}<article><p>{P1}</p><table><tr><th>{{{{Year of the count}}}}</th><th>{{{{Vehicles per day}}}}</th></tr><tr><td>{{{{2019, before the flood}}}}</td><td>{{{{4,300 on average}}}}</td></tr></table><p>{P2}</p></article>{FOOT}",
    "layout tables": f"<body><table><tr><td><table class='menu'><tr><td><a href='/'>Home</a></td></tr><tr><td><a href='/n'>News</a></td></tr></table></td><td><table class='content'><tr><td><p>{P1}</p><p>{P2}</p><p>{P3}</p></td></tr></table></td></tr></table>",
    "quotation": f"<body>{NAV}<article><p>{P1}</p><blockquote><p>{{{{It will change the way people in this valley get to work.}}}}</p></blockquote><p>{P2}</p></article>{FOOT}",
    "headings": f"<body>{NAV}<article><h1>{{{{Council funds a bridge}}}}</h1><h2>{{{{What was decided}}}}</h2><p>{P1}</p><h2>{{{{Why it matters}}}}</h2><p>{P2}</p><h2>{{{{What comes next}}}}</h2><p>{P3}</p></article>{FOOT}",
    "inline markup": f"<body><article><p>{{{{The <b>council</b> met on <a href='/t'>Tuesday</a> to <em>discuss</em> the bridge, and it agreed at once.}}}}</p><p>{P2}</p></article>{FOOT}",
    "references": f"<body>{NAV}<article><p>{{{{Salt &amp; pepper cost &lt; 3 &euro; at the mill&rsquo;s shop, which opens every day at nine.}}}}</p><p>{P1}</p></article>{FOOT}",
    "scripts": f"<body><script>var menu = '<p>no text</p>';</script><style>p {{ color: red }}</style><article><p>{P1}</p><script>track('x');</script><p>{P3}</p></article><noscript>Please enable scripts.</noscript>{FOOT}",
    "unclosed": f"<body>{NAV}<article><h1>{{{{A crossing at last}}}}</h1><p>{P1}<p>{P2}<p>{P3}</article>{FOOT}",
    "upper case": f"<BODY><DIV CLASS='NAV'><A HREF='/'>Home</A> <A HREF='/n'>News</A></DIV><DIV ID='content'><P>{P1}</P><P>{P2}</P></DIV><DIV ID='footer'>Copyright 2001 Mill Press</DIV></BODY>",
    "breadcrumbs": f"<body><div class='breadcrumb'><a href='/'>Home</a> &gt; <a href='/n'>News</a> &gt; <a href='/n/l'>Local</a></div><article><h1>{{{{Council funds a bridge}}}}</h1><p>{P1}</p><p>{P2}</p></article>",
    "login form": f"<body><form class='login'><label>User</label><input><label>Password</label><input><button>Log in</button></form><div class='post'><h2>{{{{A crossing at last}}}}</h2><p>{P2}</p><p>{P3}</p></div>{FOOT}",
    "nested sections": f"<body><div id='wrap'><div id='page'>{NAV}<section><section><p>{P1}</p></section><section><p>{P2}</p></section></section>{FOOT}</div></div>",
    "German": f"<body><nav><a href='/'>Startseite</a> <a href='/k'>Kontakt</a></nav><article><h1>{{{{Eine Brücke für das Tal}}}}</h1><p>{{{{Der Rat hat am Dienstag beschlossen, den ersten Abschnitt der neuen Brücke zu bezahlen, und zwar ohne Gegenstimme.}}}}</p><p>{{{{Die Arbeiten beginnen im Herbst, sobald der Boden untersucht worden ist.}}}}</p></article><footer>Impressum | Datenschutz</footer>",
    "only a menu": f"<body>{NAV}{FOOT}",
    "long": f"<body>{NAV}<article>" + f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>" * 40 + f"</article>{FOOT}",
}


@pytest.fixture(scope="module")
def trained():
    return html.train(html.labelled_pages(html.PAGES))


def wanted(page):
    parts = [entities.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.findall(r"\{\{(.*?)\}\}", page, re.S)]
    return " ".join(" ".join(parts).split())


#: Not found by the model: main text in two bare sections, without a title, an article or a name on the way.
MISSED = {"nested sections"}


@pytest.mark.parametrize("name", [pytest.param(n, marks=pytest.mark.xfail) if n in MISSED else n for n in PAGES])
def test_main_text_of_labelled_pages(trained, name):
    page = PAGES[name]
    assert html.main_text(re.sub(r"\{\{|\}\}", "", page), *trained) == wanted(page)
