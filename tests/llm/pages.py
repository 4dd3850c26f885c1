"""Pages written by hand in layouts of many kinds; blocks of main text begin with a section sign, which is taken out."""

PAGES = {
    "blog in divs": """<html><head><title>Slow bread</title></head><body class="home blog">
<div id="page"><div id="masthead"><a href="/" class="logo">The Oven Diary</a><span class="tagline">notes from a small kitchen</span></div>
<div class="menu-wrap"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/recipes">Recipes</a></li><li><a href="/about">About me</a></li></ul></div>
<div class="post-wrap"><div class="post hentry"><h2 class="entry-title">§Bread that takes three days</h2><div class="entry-meta">Posted on <a href="/d">3 March</a> by <a href="/a">Ida</a></div>
<div class="entry-content"><p>§Most loaves are in a hurry. This one is not: the dough stands in the cold for two nights, and all you do is wait.</p>
<p>§Weigh 500 g of flour, 350 g of water and 10 g of salt. A pinch of yeast is enough, because time does the rest of the work.</p>
<ul><li>§Mix in the evening and cover the bowl.</li><li>§Fold the dough once the next morning.</li></ul>
<p>§On the third day the crust sings when it leaves the oven, and the crumb is open, glossy and a little sour.</p></div>
<div class="sharedaddy"><a href="#">Tweet</a> <a href="#">Pin it</a></div></div>
<div id="comments"><h3>4 thoughts on this post</h3><ol><li><p>I tried it with rye and it was wonderful, thank you so much for sharing.</p></li><li><p>How warm is your kitchen?</p></li></ol></div></div>
<div id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">Rye crackers</a></li><li><a href="/2">Feeding a starter</a></li></ul></div>
<div id="colophon">Proudly baked since 2009. <a href="/imprint">Imprint</a></div></div></body></html>""",
    "news with sections": """<!doctype html><body><div class="cookie-consent"><p>We use cookies to improve your visit. You can change your choice at any time.</p><button>Accept</button></div>
<header role="banner"><a href="/">The Valley Post</a><nav><a href="/news">News</a> <a href="/sport">Sport</a> <a href="/weather">Weather</a></nav></header>
<main><section class="story"><h1>§River bridge to close for repairs until autumn</h1><div class="standfirst"><p>§Drivers face a detour of nine miles while engineers replace the bearings of the old crossing.</p></div>
<p class="byline">By Tom Hale, transport editor</p>
<p>§The bridge over the Lenn will close on Monday, the county said yesterday, after an inspection found cracks in two of its bearings.</p>
<div class="ad-slot"><p>Advertisement. Save on winter tyres this week only at your local garage.</p></div>
<p>§"Nobody is in danger today, but we cannot wait another winter," said the county's chief engineer, who expects the works to cost four million.</p>
<h2>§What it means for buses</h2><p>§Lines 4 and 11 will turn round at the mill. A shuttle runs every twenty minutes between the mill and the station.</p></section>
<aside class="related"><h2>More on this</h2><ul><li><a href="/x">How bridges age</a></li><li><a href="/y">The flood of 1953</a></li></ul></aside></main>
<footer><p>© The Valley Post. All rights reserved.</p><a href="/terms">Terms</a> <a href="/privacy">Privacy</a></footer></body>""",
    "table layout of old": """<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2><FONT SIZE=5>Lighthouse Society of the North Coast</FONT></TD></TR>
<TR><TD WIDTH=150 CLASS=nav><A HREF=index.html>Home</A><BR><A HREF=lights.html>The lights</A><BR><A HREF=join.html>Join us</A></TD>
<TD CLASS=content><H2>§The lamp at Skarn Point</H2><P>§The first lamp was lit on the point in the autumn of 1841. It burned rape oil, and two keepers took turns to trim its wicks all night.
<P>§When the mains arrived in 1932 the keepers stayed, for the fog signal still ran on compressed air. The last of them left in 1971.
<P>§Visitors can climb the tower on the first Sunday of each month. Stout shoes are wise, as the path is steep and often wet.</TD></TR>
<TR><TD COLSPAN=2 ALIGN=center CLASS=footer><SMALL>Last updated 12 May 1999. Mail the <A HREF=mailto:x>webmaster</A>.</SMALL></TD></TR></TABLE></BODY></HTML>""",
    "documentation": """<body><div class="topbar"><a href="/">toolbox docs</a><form class="search"><input name="q"><button>Search</button></form></div>
<div class="sidebar"><ul><li><a href="install">Installation</a></li><li><a href="config">Configuration</a></li><li><a href="faq">Questions</a></li></ul></div>
<div class="document"><div class="body" role="main"><h1>§Configuration files</h1><p>§The program reads its settings from a file in the working directory. Lines that start with a hash are comments and are left out.</p>
<pre>§[server] port = 8080 workers = 4</pre><p>§Every key can also be set through an environment variable, which wins over the file. Unknown keys stop the program with a message that names them.</p>
<h2>§Reloading</h2><p>§Send the process a hangup signal to read the file again. Connections that are open stay open while the new settings take hold.</p></div></div>
<div class="related"><a href="install">previous</a> | <a href="faq">next</a></div><div class="footer">Created with a documentation generator.</div></body>""",
    "shop article": """<body><nav class="breadcrumbs"><a href="/">Shop</a> &gt; <a href="/tea">Tea</a></nav><div class="promo-banner">Free delivery on all orders over thirty pounds until Sunday!</div>
<article class="guide"><header><h1>§How to brew green tea without bitterness</h1></header><p>§Green leaves scorch easily. Let the kettle cool for five minutes, or pour the water into a cold jug first and from there over the leaves.</p>
<p>§Two grams to a cup are plenty. Steep the first infusion for a minute, the second for half of that, and the third for as long as you like.</p><blockquote>§A good leaf forgives almost everything except boiling water.</blockquote></article>
<section class="recommended"><h3>You may also like</h3><ul><li><a href="/p1">Sencha, 100 g</a></li><li><a href="/p2">Porcelain cup</a></li></ul></section>
<div class="newsletter-signup"><p>Sign up for our newsletter and get ten percent off your next order.</p><form><input><button>Subscribe</button></form></div><footer><p>Registered in Leeds. VAT number 123456.</p></footer></body>""",
    "german magazine": """<body><header class="kopf"><a href="/">Gartenblatt</a></header><nav><ul><li><a href="/beete">Beete</a></li><li><a href="/obst">Obst</a></li></ul></nav>
<div id="content"><div class="article-body"><h1>§Wann man Äpfel schneidet</h1><p>§Der beste Zeitpunkt ist ein trockener Tag gegen Ende des Winters, wenn kein starker Frost mehr droht und die Knospen noch ruhen.</p>
<p>§Zuerst kommt alles Holz weg, das sich reibt oder nach innen wächst. Danach lichtet man die Krone, bis ein Hut hindurchfliegen könnte.</p><p>§Große Wunden heilen langsam; darum lieber jedes Jahr ein wenig als alle fünf Jahre viel.</p></div></div>
<div class="kommentare comments"><h3>Kommentare</h3><p>Vielen Dank, das hat mir sehr geholfen, mein Baum trägt wieder.</p></div><footer>Impressum Datenschutz</footer></body>""",
    "forum answer as article": """<body><div class="navbar"><a href="/">Questions</a> <a href="/tags">Tags</a></div><main><article><h1>§Why does my bicycle chain skip under load?</h1>
<p>§A chain skips when its pins no longer sit in the valleys between the teeth. Either the chain has grown with wear or the teeth have turned to hooks.</p><p>§Measure twelve links with a steel rule: more than twelve and an eighth inches means that the chain is done, and probably the cassette with it.</p></article>
<section class="comments"><p>Also check the hanger, mine was bent.</p><p>Thanks, the ruler trick worked!</p></section></main><footer>Site content is user contributed.</footer></body>""",
    "page of links": """<body><nav><ul><li><a href="/a">All topics</a></li><li><a href="/b">New today</a></li></ul></nav><div class="tag-cloud"><a href="/1">ponds</a> <a href="/2">ferns</a> <a href="/3">moss</a></div>
<footer>Contact us by mail.</footer></body>""",
    "broken markup": """<body><div class=header><a href=/>Hill Walks</a></div><div class=main-content><h1>§Over the three passes<p>§The path leaves the village by the church and climbs through beech woods for an hour<p>§At the first pass there is a spring; the second has a hut where soup is served at noon
<div class=advert>Boots half price at the outdoor shop in town.</div><p>§From the third the lake lies below you, and the last bus leaves its shore at six</div><div class=footer>Maps by the survey office.</body>""",
    "french press, names of its own": """<body><div class="c-header"><a href="/">Le Courrier du Lac</a><div class="c-nav"><a href="/politique">Politique</a><a href="/culture">Culture</a></div></div>
<div class="c-article"><h1 class="c-article__title">§Le vieux théâtre rouvrira au printemps</h1><p class="c-article__lead">§Fermée depuis huit ans, la salle de la rue des Tanneurs accueillera de nouveau le public en avril.</p>
<p>§Les travaux ont coûté six millions. La coupole a été reconstruite à l'identique, et quatre cents fauteuils neufs attendent les spectateurs.</p><p>§La première soirée sera consacrée à un opéra écrit pour la ville, que personne n'a entendu depuis un siècle.</p></div>
<div class="c-related"><h3>À lire aussi</h3><a href="/x">Une saison de concerts</a></div><div class="c-footer">Mentions légales</div></body>""",
}

#: Written after the generator and the number of its pages were settled, and read by the model once: no choice was made on them.
HELD_OUT = {
    "recipe in sections": """<body><div id="cookiebar"><p>This site uses cookies. By going on you agree.</p><a href="#">Fine</a></div><div class="site-head"><a href="/">Kettle and Crumb</a><ul><li><a href="/soups">Soups</a></li><li><a href="/cakes">Cakes</a></li></ul></div>
<div class="recipe-card"><h1>§Leek soup with barley</h1><p>§A soup for the first cold evening. The barley thickens the broth by itself, so there is no need for cream or flour.</p><h3>§Ingredients</h3><ul><li>§three leeks, washed well</li><li>§a cup of pearl barley</li><li>§two litres of stock</li></ul>
<h3>§Method</h3><ol><li>§Soften the leeks in butter for ten minutes without letting them brown.</li><li>§Add the barley and the stock, and simmer for fifty minutes.</li></ol></div><div class="rating-box">Rate this recipe <a href="#1">1</a> <a href="#2">2</a> <a href="#3">3</a></div>
<div class="you-might"><h4>You might like</h4><a href="/a">Onion tart</a><a href="/b">Pea soup</a></div><div class="site-foot">© Kettle and Crumb <a href="/contact">Contact</a></div></body>""",
    "museum page": """<html><body><header><nav aria-label="main"><a href="/visit">Visit</a><a href="/collection">Collection</a></nav></header><main id="main"><h1>§The weavers' hall</h1>
<p>§The hall was built in 1624 for the guild of weavers, who met here on the first Monday of the month to settle prices and quarrels.</p><figure><img src="x.jpg"><figcaption>§The great loom, restored in 1988.</figcaption></figure>
<p>§Its floor rests on forty oak piles driven into the river bank. Two of them were replaced last year after divers found that shipworm had eaten them hollow.</p></main><section class="opening-hours"><h2>Opening hours</h2><p>Daily from ten to five, closed on Mondays.</p></section><footer><p>Supported by the city.</p></footer></body></html>""",
    "spanish blog": """<body><div class="cabecera"><h2><a href="/">Cuaderno de montaña</a></h2></div><div class="barra"><a href="/rutas">Rutas</a> | <a href="/fotos">Fotos</a></div><div class="entrada"><h1>§Una noche en el refugio</h1>
<p>§Llegamos al refugio cuando ya caía la niebla. El guarda había encendido la estufa y nos esperaba con una olla de garbanzos.</p><p>§Por la mañana el valle estaba cubierto de nubes y las cumbres parecían islas. Bajamos despacio, sin hablar, para no romper el silencio.</p></div>
<div class="comentarios"><h3>2 comentarios</h3><p>Qué ganas de volver a subir, gracias por contarlo.</p></div><div class="pie">Hecho a mano en Huesca.</div></body>""",
    "company news, all divs and spans": """<body><div class="wrapper"><div class="top"><span>Norden Pumps</span><span><a href="/products">Products</a></span><span><a href="/jobs">Jobs</a></span></div><div class="left-col"><div><a href="/2023">2023</a></div><div><a href="/2022">2022</a></div></div>
<div class="middle-col"><div class="headline">§New test bench in service</div><div class="text">§Since Tuesday our works can test pumps of up to two megawatts under full load, which used to mean a journey of six hundred kilometres.</div><div class="text">§The bench recovers nine tenths of the energy and feeds it back into the grid of the works. It took fourteen months to build.</div></div>
<div class="bottom">Norden Pumps Ltd. Registered office: Harbour Road 4. <a href="/legal">Legal notice</a></div></div></body>""",
    "wiki": """<body><div id="mw-head"><a href="/login">Log in</a></div><div id="mw-panel"><ul><li><a href="/main">Main page</a></li><li><a href="/random">Random article</a></li></ul></div><div id="content"><h1 id="firstHeading">§Dry stone wall</h1><div id="bodyContent"><div id="toc"><h2>Contents</h2><ul><li><a href="#1">Building</a></li><li><a href="#2">Uses</a></li></ul></div>
<p>§A dry stone wall is built without mortar. It stands because its stones are set with care, each bearing on two below it and tied across by long stones called throughs.</p><h2>§Building</h2><p>§The footing is dug to firm ground. Two faces lean towards each other as they rise, and small stones, the hearting, fill the gap between them.</p><h2>§Uses</h2><p>§Walls part fields, hold back terraces and shelter sheep from the wind.</p></div></div>
<div id="footer"><ul><li>This page was last edited on 3 May.</li><li><a href="/about">About</a></li></ul></div></body>""",
    "press release in a table": """<html><body><table><tr><td><a href="/">Harbour Authority</a></td><td><a href="/press">Press</a> <a href="/ships">Ships</a></td></tr></table><table><tr><td width=120><a href="/a">Tides</a><br><a href="/b">Tariffs</a></td><td><h1>§Third lock opens to traffic</h1><p>§The first ship passed the new lock at noon today, eleven weeks earlier than planned. It can take vessels of up to two hundred metres.</p><p>§"Waiting times will fall by half," said the harbour master, "and that is good for the crews as much as for trade."</p></td></tr></table><p align=center><font size=1>Harbour Authority, Quay 1. All rights reserved.</font></p></body></html>""",
}
