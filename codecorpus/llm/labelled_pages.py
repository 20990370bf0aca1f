"""A small table of pages made by hand: html, and the blocks of it that are main text."""

from __future__ import annotations

_NAV = '<nav><ul><li><a href="/a">Start</a></li><li><a href="/b">News</a></li></ul></nav>'
_LINKS = "".join(f'<li><a href="/{k}">Link number {k}</a></li>' for k in range(4))
_LONG = (
    "The council met on Monday to talk about the new bridge over the river, which is to open next "
    "year after a long delay that many people in the town had complained about in letters."
)
_OTHER = (
    "Work had stopped for three months because the ground was softer than the plans had said, and "
    "so the builders had to wait until a second survey of the whole bank was finished."
)
_THIRD = (
    "Nobody was hurt when part of the old wall fell down in the night, but the road beside it will "
    "stay closed until the end of the week while the stones are carried away."
)
_REMARK = (
    "I read this twice and I still think that the whole plan is far too expensive for a town of "
    "our size, and I have said so before, but nobody ever listens to what we say here."
)

LABELLED_PAGES: tuple[tuple[str, tuple[str, ...]], ...] = (
    (
        f'<html><head><title>Bridge</title></head><body>{_NAV}<div class="ad">Buy shoes now.</div>'
        f"<article><h1>New bridge</h1><p>{_LONG}</p><p>Short.</p><p><b>{_OTHER}<br></article>"
        "<footer>&copy; The paper &middot; All rights reserved.</footer></body></html>",
        ("New bridge", _LONG, "Short.", _OTHER),
    ),
    (
        f'<body><header><h2>The Paper</h2></header>{_NAV}<main><h1>Old wall</h1><p>{_THIRD}</p>'
        f'<p>See <a href="/x">the map</a> for more.</p></main><aside><h3>More news</h3><ul>{_LINKS}'
        f"</ul></aside><section class='comments'><p>{_REMARK}</p><p>Me too.</p></section></body>",
        ("Old wall", _THIRD, "See the map for more."),
    ),
    (
        f'<body><div id="menu">{_LINKS}</div><div class="content"><h1>Two things</h1><p>{_LONG}</p>'
        f"<p>{_OTHER}</p><ul><li>First point of the list</li><li>Second</li></ul></div>"
        f'<div id="sidebar"><p>{_THIRD}</p><ul>{_LINKS}</ul></div>'
        '<div class="cookie-notice">We use cookies to make this site work. <button>Accept</button>'
        "</div></body>",
        ("Two things", _LONG, _OTHER, "First point of the list", "Second"),
    ),
    (
        f'<body><form action="/s"><label>Search</label><input name="q"></form><article>'
        f'<header><h1>Title here</h1></header><p>{_OTHER}</p><div class="advert">{_REMARK}</div>'
        f"<p>Yes.</p><p>{_LONG}</p></article><div id='comments'><h3>Comments</h3><p>{_REMARK}</p>"
        "<form><textarea></textarea><button>Send</button></form></div>"
        "<footer><p>Terms and contact</p></footer></body>",
        ("Title here", _OTHER, "Yes.", _LONG),
    ),
    (
        f"<body><ul>{_LINKS}</ul><h1>Plain page</h1><p>{_LONG}</p><p>{_OTHER}</p><p>{_THIRD}</p>"
        "<p>Copyright by us</p></body>",
        ("Plain page", _LONG, _OTHER, _THIRD),
    ),
    (
        f"<body><table><tr><td><a href='/1'>One</a> <a href='/2'>Two</a></td></tr></table>"
        f"<div><p>{_THIRD}</p><p>{_LONG}</p></div><div><a href='/n'>Next page of the list</a></div>"
        "<div>Powered by something</div></body>",
        (_THIRD, _LONG),
    ),
    (
        f'<body><div role="banner">The Paper of the town</div><div role="main"><p>{_THIRD}</p>'
        f"<blockquote>{_REMARK}</blockquote><p>That is all.</p></div>"
        f'<div role="complementary">{_OTHER}</div></body>',
        (_THIRD, _REMARK, "That is all."),
    ),
    (
        f'<body>{_NAV}<article><h1>A list</h1><p><a href="/all">All of this is a link to read</a></p>'
        f"<ol><li>{_LONG}</li><li>One</li></ol><h2>End</h2><p>Bye.</p></article>"
        f"<aside>{_REMARK}</aside><div class='newsletter'>Sign up for our letter today</div></body>",
        ("A list", "All of this is a link to read", _LONG, "One", "End", "Bye."),
    ),
    (
        f"<body><p>{_OTHER}</p><p>{_REMARK}</p></body>",
        (_OTHER, _REMARK),
    ),
    (
        f"<body><div><a href='/'>Home</a></div><div>{_LONG} {_OTHER}</div><div>{_THIRD}</div>"
        f"<ul>{_LINKS}</ul></body>",
        (f"{_LONG} {_OTHER}", _THIRD),
    ),
    (
        f'<body><nav>Menu</nav><article><p>Only this.</p></article><div class="social">{_REMARK}</div>'
        "<footer>Imprint</footer></body>",
        ("Only this.",),
    ),
    (
        f'<body>{_NAV}<article><h1>With extras</h1><p>{_LONG}</p><div class="share">Share</div><p>Ok.'
        f'</p><div class="related"><p>Read this too</p></div><p>{_OTHER}</p><div class="ad">Ad</div>'
        "<p>The end</p><footer>By someone</footer></article><footer>Imprint</footer></body>",
        ("With extras", _LONG, "Ok.", _OTHER, "The end"),
    ),
    (
        f'<body><main><h2>Notes</h2><p>{_THIRD}</p><aside>Side note</aside><p>Go on</p>'
        f'<form><label>Mail</label></form><ul class="comments"><li>{_REMARK}</li><li>First</li></ul>'
        "</main></body>",
        ("Notes", _THIRD, "Go on"),
    ),
    (
        f'<body>{_NAV}<div class="ad">Buy now.</div><article><h1>Cut off</h1><p>{_LONG}</p><p>And th',
        ("Cut off", _LONG, "And th"),
    ),
    (
        f"<body><header>Paper</header><article><h1>Links</h1><p><a href='/1'>Part one</a></p>"
        f"<p><a href='/2'>Two</a></p><p>{_OTHER}</p><p><a href='/3'>Part three</a></p></article></body>",
        ("Links", "Part one", "Two", _OTHER, "Part three"),
    ),
    (
        f'<body><div id="nav">{_LINKS}</div><main><h1>Short</h1><p>{_THIRD}</p><p>Fine.',
        ("Short", _THIRD, "Fine."),
    ),
    (
        f'<body>{_NAV}<div class="post"><h2>Head</h2><p>{_REMARK}</p><p><a href="/p">Photo</a></p>'
        f"<p>{_LONG}</p><p>Last</p></div></body>",
        ("Head", _REMARK, "Photo", _LONG, "Last"),
    ),
    (
        f"<body><div><a href='/'>Home</a> <a href='/b'>Blog</a></div><h1>No marks</h1><p>{_THIRD}</p>"
        f"<p>{_REMARK}</p><div>Made with care</div></body>",
        ("No marks", _THIRD, _REMARK),
    ),
    (
        f"<body><div>Our site</div><div><p>{_LONG}</p><p>{_OTHER}</p></div><ul>{_LINKS}</ul>"
        "<div>All rights reserved</div></body>",
        (_LONG, _OTHER),
    ),
    # Pages that end inside the article.
    *(
        (
            f'<body>{_NAV}<div class="ad">Buy now.</div><article><h1>Cut off</h1><p>{_LONG}</p><p>{rest}',
            ("Cut off", _LONG, rest),
        )
        for rest in ("Then they all", "Then they all went home", _OTHER[:60].strip(), _OTHER, _THIRD)
    ),
    (
        f"<body>{_NAV}<article><p>{_OTHER}</p></article></body>",
        (_OTHER,),
    ),
)
