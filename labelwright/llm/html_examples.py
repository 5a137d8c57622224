"""Labelled example pages: fixed values the block labeller is trained on, beside pages whose own markup states the article.

``data-keep`` marks what is main text (1) and what isn't (0); it is read for
training only.
"""

EXAMPLES = [
    """<body><header class="site-header"><a href="/" class="logo">The Daily Example</a><p>News for everyone, every day.</p></header>
    <nav class="main-menu"><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/a">Arts</a></li></ul></nav>
    <div id="cookie-notice"><p>We use cookies to improve your visit. By going on you accept them.</p><button>Accept</button></div>
    <main data-keep="1"><article><h1>River level falls after a dry spring</h1><p>The river has dropped to its lowest level in a decade, officials said on Monday.</p>
    <p>Farmers along the valley fear for the harvest. "We have not seen this since I was a boy," said one of them.</p>
    <aside data-keep="0" class="related"><h3>Related stories</h3><ul><li><a href="/1">Drought warning issued</a></li></ul></aside>
    <p>Rain is expected by the end of the week.</p>
    <section data-keep="0" id="comments" class="comments"><h2>3 comments</h2><div class="comment"><p>I live there and it is really bad, nobody does a thing about it.</p></div>
    <div class="comment reply"><p>Same here. We carry water in buckets.</p></div><form class="comment-form"><label>Your comment</label><button>Post</button></form></section></article></main>
    <aside class="sidebar"><h3>Most read</h3><ol><li><a href="/2">Ten recipes for summer evenings</a></li></ol><div class="ad">Buy one, get one free.</div></aside>
    <footer><p>Copyright 2020 The Daily Example. All rights reserved.</p><a href="/imprint">Imprint</a></footer></body>""",
    """<body><div id="top"><div class="nav"><a href="/">Home</a> <a href="/blog">Blog</a> <a href="/about">About</a></div></div>
    <div class="banner advert"><p>Learn a language in three weeks with our course.</p></div>
    <div id="wrapper"><div id="content" class="post-content" data-keep="1"><h2>How to sharpen a kitchen knife</h2>
    <div>Start with a coarse stone and hold the blade at a steady angle of about twenty degrees.</div>
    <div>Move it in even strokes, then turn it over and do the same on the other side.</div><ul><li>Wet the stone first.</li><li>Do not press too hard.</li></ul>
    <div>Finish on a fine stone until a sheet of paper is cut cleanly.</div></div>
    <div class="share-buttons social"><a href="#">Share</a><a href="#">Tweet</a></div>
    <div class="newsletter subscribe"><p>Subscribe to our newsletter and never miss a post.</p><form><input name="mail"><button>Sign up</button></form></div>
    <div id="respond" class="comment-respond"><h3>Leave a reply</h3><p>Your address will not be published.</p></div>
    <div class="comment-list"><p>Great tip, my knives have never been so sharp. Thank you for this!</p><p>I prefer a steel rod, but this works as well.</p></div></div>
    <div id="sidebar"><div class="widget"><h4>About me</h4><p>I cook, write and travel. This blog is about all three of them.</p></div><div class="widget tags"><a href="#">knives</a> <a href="#">tools</a></div></div>
    <div id="footer"><p>Powered by a small blog engine. Contact us at any time.</p></div></body>""",
    """<body><table class="layout"><tr><td class="menu"><a href="/1">Start</a><br><a href="/2">Products</a><br><a href="/3">Contact</a></td>
    <td class="text" data-keep="1"><h1>History of the mill</h1><p>The mill was built in 1782 and ground corn for the whole district.<p>In 1911 it burned down and was rebuilt in brick. Today it is a museum.</td></tr>
    <tr><td class="bottom"><small>Last changed in May. Imprint and privacy.</small></td></tr></table></body>""",
    """<body><div role="banner"><div class="masthead">Weekly Letter</div></div><div role="navigation" class="breadcrumb"><a href="/">Home</a> / <a href="/g">Garden</a></div>
    <div class="consent notice" role="dialog"><p>This site stores data on your device. Read our policy for details.</p></div>
    <div role="main" class="story" data-keep="1"><header><h1>Growing tomatoes on a balcony</h1></header><section class="story-body"><p>Tomatoes need sun, warmth and a large pot with good soil.</p>
    <figure><figcaption>A plant in July.</figcaption></figure><blockquote>Water them in the morning, never at noon.</blockquote><p>Pinch out the side shoots once a week, and feed them from June on.</p></section>
    <div data-keep="0" class="promo sponsored"><p>Sponsored: the best pots at half the price, only this week.</p></div><p>Harvest them when they are red and come off easily.</p></div>
    <div class="related-posts"><h3>You may also like</h3><p><a href="/p">Beans in boxes</a></p><p><a href="/q">Herbs all winter long</a></p></div>
    <div role="contentinfo"><p>All texts may be shared freely. Terms of use apply.</p></div></body>""",
    """<body><form class="search" action="/s"><label>Search</label><input><button>Go</button></form><ul class="menu"><li><a href="/x">Topics</a></li><li><a href="/y">People</a></li></ul>
    <div class="alert warning"><p>This page is out of date. Please see the new version.</p></div>
    <section class="article-body" data-keep="1"><h1>Notes on the meeting</h1><p>Twelve members came. The treasurer read the report, which was accepted.</p><p>The next meeting will be held in October.</p><pre>Agenda: 1. report 2. vote</pre></section>
    <section class="discussion"><h2>Discussion</h2><article class="comment"><p>I could not come, was anything said about the roof?</p></article><article class="comment"><p>Yes, it will be mended in spring, they said.</p></article></section>
    <form class="login"><p>Log in to write a comment.</p></form><div class="pagination"><a href="?p=1">1</a><a href="?p=2">2</a></div><footer class="page-footer">Made with care.</footer></body>""",
    """<body><nav><a href="/">Index</a></nav><article data-keep="1"><h1>A short walk</h1><p>One line only.</p></article><footer>&copy; 2021</footer></body>""",
    """<body><div class="header"><p>Welcome to the portal of the town. Opening hours are nine to five.</p></div><article data-keep="1"><p>The bridge will be closed in August.</p><p>Buses will take another way, as the plan shows.</p>
    <div data-keep="0" class="advertisement">Our sponsor sells tyres. Come and see us.</div><p>Work should be done by autumn.</p><div data-keep="0" class="ad-slot"><p>A new car for less money than you think.</p></div><div data-keep="0" class="comments-area"><p>Once again a closure in the middle of the season, well done.</p></div></article>
    <aside><p>Weather: sunny and warm, with a light wind from the west.</p></aside><aside class="notice"><p>Please note that our office moves in July.</p></aside><footer><p>Town hall, main square. Call us on weekdays.</p></footer></body>""",
    """<body><p class="notice">Please allow notices so that we can tell you about new stories.</p><div class="entry" data-keep="1"><h1 class="title">Why bread rises</h1><p>Yeast eats sugar and gives off gas, and the dough holds it.</p><p>A warm kitchen speeds this up; a cold one slows it down, which gives more taste.</p></div>
    <div class="comments"><ul><li>My grandmother always used a cold cellar for it.</li><li>Try it with rye, it works too.</li></ul></div><div class="sponsor">Flour from the old mill, now online.</div><div class="site-info">All rights reserved.</div></body>""",
    """<article data-keep="1"><p>Only this one paragraph is there.</p></article>""",
    """<main data-keep="1"><h1>Short</h1><p>A page with nothing around it.</p></main>""",
    """<html><body data-keep="1"><p>A plain page without any menu, as pages once were.</p><p>It has a second paragraph, and then it ends.</p></body></html>""",
    """<div data-keep="1"><h2>Minutes</h2><p>The doors opened at seven. All were there.</p><ul><li>First the songs.</li><li>Then the speeches.</li></ul></div>""",
    """<body><div class="menu">Start News Archive</div><div class="content" data-keep="1"><p>The old lighthouse is open again after two years of work.</p><p>Visitors may climb the tower at weekends.</p></div><div id="comments"><p>We were there on Sunday, and it was lovely.</p><p>So were we, as every year.</p></div></body>""",
    """<article data-keep="1"><p>Dry walls need no mortar and last for ages.</p><aside data-keep="0"><p>More on walls in our garden pages.</p></aside><form data-keep="0"><p>Write your name here, please.</p></form><p>Lay the largest stones first.</p></article><aside><p>Offers of the week, for members only.</p></aside><form><p>Search the whole site from here.</p></form>""",
    """<body><header><p>All the news of the valley, since 1950.</p></header><article data-keep="1"><p>The choir sang for an hour, and nobody left.</p></article><div class="user-comments"><p>I would have liked to hear it.</p></div><div class="reader-reactions comment-thread"><p>It was too long, if you ask me.</p></div><footer><p>Write to us at any time, we read it all.</p></footer></body>""",
]
