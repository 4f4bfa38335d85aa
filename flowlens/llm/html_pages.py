"""Labelled pages that the content model is trained on, written for this purpose.

An element with y="1" is article content, with y="0" not; elements within take the label of the nearest such element.
The layouts differ in their elements, names and nesting; some leave tags open.
"""

_LONG = (
    "The river had risen twice that spring, and each time the millers moved their stores to the upper barn before the water came. ",
    "Nobody in the valley expected the third flood, which arrived at night, after two days of quiet weather and a clear sky. ",
    "According to the survey, most of the older bridges held, although their railings were bent and the approaches washed away. ",
    "Repairs began within a week; the council paid for timber, the farmers lent their carts, and the school closed for a month. ",
    "What remains of the old embankment can still be seen from the road, a line of stones half hidden under grass and nettles. ",
)


def _p(n: int, tag: str = "p", close: bool = True) -> str:
    return "".join(f"<{tag}>{_LONG[i % 5] * (1 + i % 3)}" + f"</{tag}>" * close for i in range(n))


def _links(*names: str) -> str:
    return "".join(f'<li><a href="/{x}">{x}</a></li>' for x in names)


_NAV = f'<nav y="0"><ul>{_links("Home", "World", "Sports", "Contact")}</ul></nav>'
_FOOT = '<footer y="0">&copy; valley.example &middot; All rights reserved. Terms of use and privacy.</footer>'

PAGES = (
    f'<body>{_NAV}<div class="ad" y="0">Fresh bread every morning, two for one.</div><article y="1"><h1>The third flood</h1>{_p(3)}<p>So it ended.</p></article>{_FOOT}</body>',
    f'<body>{_NAV}<div class="ad" y="0">Shoes at half price. Only today in all our shops, while stocks last.</div><article y="1"><h1>A short note</h1><p><b>Repairs began.<br><p>Soon.</p></article>{_FOOT}',
    f'<body><nav y="0"><ul>{_links("a", "b.", "Über")}</ul></nav><div class="ad" y="0">{_LONG[1]}</div><article y="1"><h1>Stones</h1><p><b>{_LONG[0]}<br>{_p(2)}<p>Yes.</p><p>{_LONG[4]}</article><footer y="0">&copy; {_LONG[3]}</footer>',
    f'<body><header class="site-header" y="0"><a href="/">Valley News</a><p>News from the valley since 1950</p></header>{_NAV}<main y="1"><h1>Bridges</h1>{_p(4)}<ul><li>{_LONG[2]}</li><li>Railings were bent.</li></ul><h2>Costs</h2>{_p(1)}</main>'
    f'<aside class="sidebar" y="0"><h3>Most read</h3><ul>{_links("Mills", "Barns", "Roads")}</ul></aside>{_FOOT}</body>',
    f'<body><div id="menu" y="0"><a href="/a">Start</a> | <a href="/b">Archive</a></div><div id="content" y="1"><h1>Old roads</h1><div class="post-body">{_p(3)}<blockquote>{_LONG[1]}</blockquote>{_p(1)}</div></div>'
    f'<div class="comments" y="0"><h3>2 comments</h3><div class="comment"><p>I remember that night very well, we lost two cows and the cart.</p></div><div class="comment"><p>{_LONG[2]}</p></div><form><label>Your name</label><textarea>Write here</textarea><button>Send</button></form></div>'
    f'<div class="sidebar" y="0"><p>Subscribe to our weekly letter and never miss a story.</p></div><div id="footer" y="0">Imprint, contact and terms</div></body>',
    f'<body><div class="cookie-notice" y="0"><p>We use cookies to improve this site. By going on you agree to their use.</p><button>Accept</button></div><div class="wrapper"><div class="content" y="1"><h1>Timber</h1>{_p(2, close=False)}</div>'
    f'<div class="related" y="0"><h4>Related stories</h4><ul>{_links("Nettles on the wall", "The upper barn", "A clear sky at night")}</ul></div></div>{_FOOT}</body>',
    f'<body><section class="post" y="1"><h2>Nettles</h2>{_p(5)}<pre>count stones: 12\ncount bridges: 4</pre>{_p(1)}</section><section id="comments" y="0"><article><p>{_LONG[3]}</p></article><article><p>Thank you for this story!</p></article></section></body>',
    f'<body y="1">{_p(3)}</body>',
    f'<body y="1"><h1>Plain page</h1>{_p(2)}<p>The end.</p></body>',
    f'<body><table><tr><td class="nav" y="0"><a href="/1">One</a><br><a href="/2">Two</a></td><td class="text" y="1"><h1>Table page</h1>{_p(2)}<p>{_LONG[4]}</td></tr></table></body>',
    f'<body>{_NAV}<div class="breadcrumb" y="0"><a href="/">Home</a> &gt; <a href="/n">News</a></div><article class="story" y="1"><h1>Carts</h1>{_p(2)}<figure><img src="c.png"><figcaption>A cart before the mill, in the year of the flood.</figcaption></figure>{_p(2)}<ol><li>First, the stores.</li><li>Then, the carts.</li></ol></article>'
    f'<div class="share" y="0"><a href="/t">Share</a> <a href="/m">Mail</a></div><div class="newsletter" y="0"><form><p>Sign up for our newsletter, it is free.</p><input name="m"><button>Join</button></form></div>{_FOOT}</body>',
    f'<body><header y="0"><h1>Valley Blog</h1><form class="search"><input name="q"><button>Search</button></form></header><div class="entry" y="1"><h2>A quiet summer</h2>{_p(3)}<h3>What remains</h3><p>Little.</p><p>{_LONG[0]}</p></div>'
    f'<div class="pagination" y="0"><a href="/p1">Older posts</a> <a href="/p2">Newer posts</a></div><div class="banner advert" y="0"><p>{_LONG[2]}</p></div><footer y="0"><ul>{_links("About", "Help", "Jobs")}</ul></footer></body>',
    f'<body><div class="notice" y="0">This page was last changed a year ago and may be out of date.</div><article y="1"><header><h1>With a head of its own</h1></header>{_p(2)}<table><tr><th>Year</th><th>Level</th></tr><tr><td>1950</td><td>3.4</td></tr></table>{_p(1)}</article>'
    f'<aside y="0"><p>{_LONG[4]}</p><p>Sponsored</p></aside></body>',
    f'<body>{_NAV}<div class="ad" y="0">{_LONG[0]}</div><article y="1"><h1>Carts.</h1><p>They came.</p></article>{_FOOT}</body>',
    f'<body>{_NAV}<div class="ad" y="0">{_LONG[3]}{_LONG[2]}</div><article y="1"><h1>The mill</h1><p><b>The mill.<br></article>{_FOOT}</body>',
    f'<body>{_NAV}<div class="ad" y="0">Cheap.</div><article y="1"><p>Closed</p></article>{_FOOT}</body>',
    f'<body>{_NAV}<div class="promo" y="0">{_LONG[4]}</div><article y="1"><h1>Names | Places</h1><p>One | two | three | four</p><p>Ten | eleven</p></article>{_FOOT}</body>',
    f'<body>{_NAV}<main y="1"><h1>Hours</h1><p>From nine to five.</p></main><aside y="0"><p>{_LONG[1]}</p><p>{_LONG[2]}</p></aside>{_FOOT}</body>',
    f'<body>{_NAV}<section class="news" y="1"><h2>Levels</h2><p>Rising.</p><ul><li>North: high</li><li>South: low</li></ul></section><form y="0"><p>Tell us what you think of this page.</p><label>Mail</label><input></form>{_FOOT}</body>',
    f'<body>{_NAV}<div class="comments" y="0"><article><p>{_LONG[0]}</p><p>Nice.</p></article></div>{_FOOT}</body>',
    f'<body>{_NAV}<article y="1"><h1>Hay</h1><p>Dry at last.</p></article><aside y="0">{_p(4)}</aside><section class="comments" y="0">{_p(5)}</section><footer y="0">{_p(3)}</footer></body>',
    f'<body><header y="0">{_p(2)}</header><div class="article-text" y="1">{_p(2)}</div><div class="sidebar" y="0">{_p(4)}<ul><li>{_LONG[0]}</li><li>{_LONG[1]}</li></ul></div><div class="notice" y="0">{_p(2)}</div></body>',
    f'<body><nav y="0">{_p(2)}</nav><main y="1"><h2>Oats</h2>{_p(1)}<ul><li>Sown late</li><li>Cut early</li><li>{_LONG[3]}</li></ul></main><form y="0">{_p(3)}</form><div class="advert" y="0">{_p(3)}</div>'
    f'<ol class="comment-list" y="0"><li>{_LONG[2]}</li><li>{_LONG[4]}</li><li>Well said.</li></ol></body>',
)
