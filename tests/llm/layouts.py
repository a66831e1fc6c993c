"""Pages written by hand after common kinds of sites, with the blocks that are their main text. No generator or element rule labelled them."""

LAYOUTS = {
    "weblog": (
        """<!DOCTYPE html><html><head><title>On bread</title></head><body class="post-template single"><div id="page" class="hfeed site"><div class="site-branding"><p class="site-title"><a href="/">Crumbs</a></p>
<p class="site-description">A baker's diary</p></div><div class="menu-main-container"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li><li><a href="/recipes">Recipes</a></li></ul></div>
<div class="entry-content"><h1>On bread</h1><p>Flour, water and salt are all one needs, and yet hardly any two loaves are alike.</p><p>I weigh the water first, because a wet dough forgives more than a dry one.</p>
<h2>The starter</h2><p>Feed it every day. When it doubles in four hours it is ready, and not before.</p><ul><li>Fifty grams of rye</li><li>Fifty grams of water</li></ul><p>Then leave it alone overnight.</p></div>
<div class="sharedaddy social"><ul><li><a href="#">Share on X</a></li><li><a href="#">Email</a></li></ul></div><div id="comments"><h3>2 thoughts on this</h3><div class="comment">Ann says: lovely crumb!</div><div class="comment">Bo says: mine never rises.</div></div>
<div id="secondary" class="widget-area sidebar"><h3>Recent posts</h3><ul><li><a href="/a">Ovens</a></li><li><a href="/b">Knives</a></li></ul></div><div class="footer">Copyright 2020 Crumbs. All rights reserved.</div></div></body></html>""",
        ["On bread", "Flour, water and salt are all one needs, and yet hardly any two loaves are alike.", "I weigh the water first, because a wet dough forgives more than a dry one.", "The starter", "Feed it every day. When it doubles in four hours it is ready, and not before.", "Fifty grams of rye", "Fifty grams of water", "Then leave it alone overnight."],
    ),
    "news": (
        """<html><body><header role="banner"><a href="/">The Daily Lantern</a><nav><a href="/world">World</a> <a href="/sport">Sport</a></nav></header><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
<main><article><h1>Bridge reopens after nine months</h1><p>The old bridge over the Lenne was opened to traffic again on Monday, nine months after a barge had struck its middle pier.</p><div class="ad-slot">Advertisement</div>
<p>Engineers replaced forty tonnes of stone and a good part of the deck.</p><p>&ldquo;It will stand for another century,&rdquo; the mayor said.</p><blockquote>We had feared the worst.</blockquote><p>A second phase begins in spring.</p></article>
<aside><h2>More on this</h2><ul><li><a href="/1">Barge skipper fined</a></li><li><a href="/2">A short history of the bridge</a></li></ul></aside></main><footer><p>Terms of use</p><p>Privacy</p></footer></body></html>""",
        ["Bridge reopens after nine months", "The old bridge over the Lenne was opened to traffic again on Monday, nine months after a barge had struck its middle pier.", "Engineers replaced forty tonnes of stone and a good part of the deck.", "“It will stand for another century,” the mayor said.", "We had feared the worst.", "A second phase begins in spring."],
    ),
    "manual": (
        """<html><body><div class="navbar"><a href="/">Docs</a> <a href="/api">API</a><form class="search"><input name="q"><button>Search</button></form></div><div class="row"><div class="sidebar toc"><ul><li><a href="#i">1 Install</a></li><li><a href="#c">2 Configure</a></li><li><a href="#r">3 Run</a></li></ul></div>
<div class="document" role="main"><section id="i"><h1>Install</h1><p>Unpack the archive into a folder of your choice and add its bin folder to the path.</p><pre>tar xf tool.tar</pre></section><section id="c"><h2>Configure</h2><p>All settings live in one file, which is read once when the program starts.</p>
<table><tr><th>Name</th><th>Meaning</th></tr><tr><td>port</td><td>where it listens</td></tr></table></section></div></div><div class="footer" role="contentinfo">Built with care</div></body></html>""",
        ["Install", "Unpack the archive into a folder of your choice and add its bin folder to the path.", "tar xf tool.tar", "Configure", "All settings live in one file, which is read once when the program starts.", "Name", "Meaning", "port", "where it listens"],
    ),
    "plain": (
        """<html><head><title>Notes</title></head><body><h1>Notes on the tides</h1><p>Twice a day the water comes and goes, and nobody here takes any notice of it.</p><p>At spring tide the meadow behind the dyke is wet for an hour.</p><p>We measured the height at the third post for a whole year.</p></body></html>""",
        ["Notes on the tides", "Twice a day the water comes and goes, and nobody here takes any notice of it.", "At spring tide the meadow behind the dyke is wet for an hour.", "We measured the height at the third post for a whole year."],
    ),
    "magazine": (
        """<html><body><div class="topbar"><ul class="nav-list"><li><a href="/">Start</a></li><li><a href="/mag">Magazine</a></li><li><a href="/shop">Shop</a></li></ul></div><div class="newsletter-popup"><h3>Subscribe to our newsletter</h3><form><input name="email"><button>Sign up</button></form></div>
<section class="story"><h2>The last lamplighter</h2><p>Every evening at dusk he walks the same eleven streets with a pole over his shoulder.</p><p>There are ninety-one lamps left, and he knows which of them hiss.</p><p>His father did it before him; his daughter builds bridges.</p></section>
<div class="related"><h3>You may also like</h3><ul><li><a href="/x">The ferryman of Oder</a></li><li><a href="/y">A night in the signal box</a></li></ul></div><div class="sponsored"><p>Sponsored: buy lamps now, half price!</p></div><footer><ul><li><a href="/c">Contact</a></li><li><a href="/p">Privacy</a></li></ul></footer></body></html>""",
        ["The last lamplighter", "Every evening at dusk he walks the same eleven streets with a pole over his shoulder.", "There are ninety-one lamps left, and he knows which of them hiss.", "His father did it before him; his daughter builds bridges."],
    ),
    "unclosed": (
        """<BODY><DIV ID=nav><A HREF=/>Home</A> <A HREF=/list>List</A></DIV><DIV CLASS=content><H1>Moths of the valley</H1><P>Most of them fly in June, when the nights are warm enough to sit outside.<P>A white sheet and a lamp are all the gear it takes.<P>We counted two hundred and six kinds.</DIV><DIV CLASS=footer>Last changed in May</DIV></BODY>""",
        ["Moths of the valley", "Most of them fly in June, when the nights are warm enough to sit outside.", "A white sheet and a lamp are all the gear it takes.", "We counted two hundred and six kinds."],
    ),
}
