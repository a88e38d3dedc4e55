"""The small labelled table behind the block classifier: pages whose main-text blocks carry the attribute data-keep."""

PAGES = [
    # A news page with the usual frame.
    """<html><head><title>Bridge reopens</title><style>p{}</style></head><body>
    <header><a href="/">The Daily</a><p>Your local paper since ages past</p></header>
    <nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather today</a></li></ul></nav>
    <div class="ad">Buy two pairs of boots and get a third pair free this week only.</div>
    <article><h1 data-keep>Bridge reopens after floods</h1>
    <p data-keep>The old bridge over the river was opened to traffic on Monday after three months of repairs to its northern pier.</p>
    <p data-keep>Nobody was hurt.</p><p data-keep>Yes.</p>
    <p data-keep>Engineers said that the <a href="/pier">pier</a> had been undercut by the flood and that they had to fill the hole with stone before they could lay the road again.</p>
    <p data-keep>More floods are forecast.</p></article>
    <footer>Copyright The Daily and its many authors. All rights reserved everywhere.</footer></body></html>""",
    # Short paragraphs only; an advert inside the article; a sidebar.
    """<body><div class="cookie-notice">We use cookies to make this site better for you and for our partners.</div>
    <main><h1 data-keep>Notes</h1><p data-keep>Rain.</p><p data-keep>More rain.</p>
    <div class="advert"><p>Umbrellas at half the price, today and tomorrow.</p></div>
    <p data-keep>Then the sun came out.</p><ul><li data-keep>boots</li><li data-keep>a hat</li></ul><p data-keep>The end.</p></main>
    <aside><h3>Popular</h3><p>What everyone reads at the moment on our site.</p><a href="/1">One thing</a></aside>
    <div id="comments"><h3>Comments</h3><p>I was there too, and it rained all day, as you say.</p><p>Me too.</p></div></body>""",
    # No article element: words and links of a block and its neighbours must do.
    """<body><div><a href="/">Home</a> <a href="/a">About</a> <a href="/c">Contact</a></div>
    <div><h2 data-keep>How to dry a wet book</h2>
    <p data-keep>Stand the book on its end with the covers open and let the water run out of it before you do anything else at all.</p>
    <p data-keep>Put a sheet of paper between every twenty pages and change the sheets as soon as they are damp, which may be every hour.</p>
    <p data-keep>Be patient.</p>
    <p data-keep>After two days close the book and lay a heavy weight on it so that the pages dry flat and the spine keeps its shape.</p></div>
    <div><a href="/x">Ten more tips for wet days</a></div><div><a href="/y">Our shop</a> | <a href="/z">Terms</a></div></body>""",
    # Page furniture before and after long divs.
    """<body><div role="banner"><p>Company of weather watchers, established for a long time</p></div>
    <div role="navigation"><a href="/">Start</a><a href="/b">Back</a></div>
    <div><div data-keep>The gauge at the mill was read every morning at seven by the miller and later by his daughter, who kept the notebook until the war and wrote down each flood that reached the second step.</div>
    <div data-keep>Her figures agree with those of the station upstream to within a hand, which is more than can be said of some of the newer instruments, and they fill the gap of nine years in the official record.</div></div>
    <div role="contentinfo"><p>All readings without guarantee by the company of watchers.</p></div></body>""",
    # A link list that is long in words, a form and a login box.
    """<body><form action="/s"><label>Search for rivers, lakes and other waters</label><input name="q"></form>
    <ul><li><a href="/1">River levels of the last seven days in all districts</a></li><li><a href="/2">Forecasts for the coming week with all their errors</a></li></ul>
    <article><h1 data-keep>Levels</h1><p data-keep>All levels fell.</p>
    <p data-keep>The lake is one metre lower than it was in spring and will fall further if there is no rain before the end of the month.</p>
    <form><p>Send me an email when levels change by more than a metre.</p></form>
    <p data-keep>The next report is due on Friday.</p></article>
    <section class="related"><p>Related: <a href="/3">why lakes fall</a></p><p>You may also like this longer story about a lake and its fish.</p></section></body>""",
    # Header inside an article, share buttons, tags, a quotation, a table.
    """<body><article><header><h1 data-keep>A year of drought</h1></header>
    <div class="share"><a href="/t">Share</a><p>Tell your friends about this story now.</p></div>
    <p data-keep>Not a drop fell in the valley between March and June, and the wells of the upper farms were dry by the first of May.</p>
    <blockquote data-keep>We carried water by hand.</blockquote>
    <table><tr><td data-keep>March</td><td data-keep>0 mm</td></tr></table>
    <p data-keep><a href="/source">The full record</a></p>
    <footer>Posted in drought by the editors of the valley record.</footer></article>
    <section class="comments"><article><p>My well was dry as well, and so was that of my neighbour, for longer than I can remember.</p></article></section>
    <div class="newsletter"><p>Get the best of our stories in your mailbox every Sunday, free.</p></div></body>""",
    # Layout classes and a form around the page; a link around a teaser.
    """<body class="has-sidebar"><form id="page"><div class="content with-sidebar no-banner social-science"><article class="post has-comments legal-news">
    <h2 data-keep>Tides of the estuary</h2><p data-keep>The tide table is older than the harbour and was drawn up by a monk who had nothing else to do.</p>
    <p data-keep>It is still right.</p><div class="share-buttons"><p>Send this to a friend</p></div></article>
    <div class="sidebar"><h3>More from us</h3><p>Ebb and flow for beginners, in twelve short lessons.</p></div>
    <a href="/t"><div>Read how the harbour was built by hand in a year</div></a></div></form></body>""",
    # Furniture only.
    """<body><nav><a href="/">Home</a></nav><div class="menu"><p>Choose a district</p></div><div class="popup"><p>Subscribe now and save a third of the price for a year.</p></div>
    <div class="alert">This site will be down for repairs on Sunday from noon to four.</div><footer><p>Imprint</p><p>Made with care by people who like water and the web.</p></footer></body>""",
    # A blog without article element, short paragraphs between long ones, a caption.
    """<body><div class="topbar"><a href="/">Blog</a></div><div class="post">
    <p data-keep>We set out before dawn because the tide would not wait and the harbour master had told us twice that he would not either.</p>
    <p data-keep>It was cold.</p>
    <figure><figcaption data-keep>The harbour at six.</figcaption></figure>
    <p data-keep>By the time we passed the light the wind had gone round to the west and the sea was as flat as the table in the kitchen at home.</p>
    <p data-keep>We slept.</p></div>
    <div><a href="/older">Older posts</a> <a href="/newer">Newer posts</a></div><div>Powered by wind</div></body>""",
    # Bare pages.
    """<html><body><p data-keep>The well in the square was dug by four brothers in a single summer and has given water in every year since then but two.</p></body></html>""",
    """<body><h1 data-keep>Wells</h1><div data-keep>There are seven wells in the village and each of them has a name that nobody outside the village knows or would understand.</div>
    <div data-keep>The deepest is closed today because a child fell in and was pulled out again by a passing carter with a good rope.</div></body>""",
    """<body><a href="/a">Up</a><p data-keep>This page has moved to the archive, where it can be read in full together with all the letters that came in after it was printed.</p></body>""",
    """<body><p><a href="/a">Here</a></p><p>Wait.</p></body>""",
    # Names of furniture on what holds the page's text; lists with links between paragraphs.
    """<body><nav><a href="/">Start</a></nav><div class="newsletter"><h1 data-keep>Letter of the month</h1>
    <p data-keep>The harbour was dredged in May and the ferries run again at low water, as they did before the storm.</p>
    <ul><li data-keep><a href="/t">The new timetable of all lines</a></li><li data-keep>and its holidays</li></ul><p data-keep>So it is.</p>
    <p data-keep>Tickets are sold at the quay and on board, and those of last year are valid until the end of the season.</p></div>
    <div class="newsletter-signup"><p>Get our letter by mail every month, free of charge.</p></div><footer>Imprint and contact</footer></body>""",
    # A form around the whole page; comments longer than the text.
    """<body><form id="aspnetForm"><div class="menu"><a href="/">Home</a><a href="/x">More</a></div>
    <div><h1 data-keep>Report on wells</h1><p data-keep>Nine wells were drilled in the valley and seven of them gave water within the first week.</p>
    <p data-keep>The other two were filled with gravel and closed.</p><p data-keep>Work goes on in spring, when the ground has thawed and the rig can be moved again.</p></div>
    <div class="search"><p>Search this site</p></div></form>
    <div class="comments"><h3>Comments</h3><p>Our well went dry two years ago and nobody came to see it, although we wrote three letters to the office.</p>
    <p>Same here, and the letters were never answered by anyone, so we dug our own well with two neighbours.</p><p>Thanks for the report, it was good to read.</p>
    <p>Where can one see the map of the nine wells, and are there plans for the upper valley as well as for ours?</p></div></body>""",
    # Short articles, and articles that end a page with a short paragraph.
    """<article><p data-keep>a note</p></article>""",
    """<body><main><p data-keep>Closed today.</p></main></body>""",
    """<body><article><h2 data-keep>Ferry</h2><p data-keep>The ferry doesn't run on Sundays in winter, as there are too few passengers to pay for the fuel.</p><p data-keep>End.</p></article></body>""",
    """<body><header><p>Site name</p></header><main><p data-keep>Moved.</p><p data-keep>See the new page of the town for all dates.</p></main></body>""",
]
