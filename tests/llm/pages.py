"""Pages written by hand, in attribute vocabularies the training generator doesn't have, and their main texts."""

PAGES = {
    "encyclopedia": (
        """<!DOCTYPE html><html lang=en><head><title>Tin whistle - Openpedia</title><link rel=stylesheet href=a.css></head><body class="skin-vector">
<div id="mw-head"><div id="p-personal"><h3>Personal tools</h3><ul><li><a href="/t">Talk</a></li><li><a href="/c">Contributions</a></li><li><a href="/l">Log in</a></li></ul></div></div>
<div id="mw-panel"><div class="portal"><ul><li><a href="/">Main page</a></li><li><a href="/r">Random article</a></li><li><a href="/d">Donate</a></li></ul></div></div>
<main id="content"><h1 id="firstHeading">Tin whistle</h1><div id="bodyContent"><div class="mw-parser-output">
<p>The <b>tin whistle</b>, also called the <a href="/pw">pennywhistle</a>, is a simple six-holed woodwind instrument. It is a type of fipple flute, putting it in the same class as the recorder.</p>
<h2>History</h2><p>The tin whistle in its modern form is from a wider family of fipple flutes which have been seen in many forms and cultures throughout the world. In Europe, such instruments have a long and distinguished history.</p>
<ul><li>A bone whistle was found in a cave in the south.</li><li>Written sources from the third century mention pipers.</li></ul>
<p>By the nineteenth century it was cheap, and it was sold by street vendors.</p></div></div></main>
<div id="footer"><ul id="footer-info"><li>This page was last edited in May.</li><li>Text is available under a free licence.</li></ul></div></body></html>""",
        "Tin whistle The tin whistle, also called the pennywhistle, is a simple six-holed woodwind instrument. It is a type of fipple flute, putting it in the same class as the recorder. History The tin whistle in its modern form is from a wider family of fipple flutes which have been seen in many forms and cultures throughout the world. In Europe, such instruments have a long and distinguished history. A bone whistle was found in a cave in the south. Written sources from the third century mention pipers. By the nineteenth century it was cheap, and it was sold by street vendors.",
    ),
    "newspaper": (
        """<html><head><title>Ferry returns after repairs | The Harbour Gazette</title><script>window.dataLayer=[];</script></head><body>
<div class="c-skiplink"><a href="#m">Skip to main content</a></div>
<div class="l-chrome"><div class="c-logo"><a href="/">The Harbour Gazette</a></div><div class="c-sections"><a href="/n">News</a> <a href="/s">Sport</a> <a href="/w">Weather</a> <a href="/o">Opinion</a></div></div>
<div class="l-page"><div class="c-headline"><h1>Ferry returns after repairs</h1></div>
<div class="c-richtext"><p>The island ferry sailed again on Monday morning after six weeks in the yard, and most of the passengers said they had hardly believed the timetable.</p>
<p>&ldquo;We missed her,&rdquo; said one of the crew. &ldquo;The small boat rolled, and nobody on it could drink a cup of tea.&rdquo;</p>
<div class="c-ad-slot"><span>Advertisement</span></div>
<p>Engineers replaced both engines and a third of the hull plates, at a cost that the council has not yet published. A report is due in spring.</p>
<p>The evening sailing will return next week, when the second crew has finished its training.</p></div>
<div class="c-mostread"><h3>Most read</h3><ol><li><a href="/1">Swans close the bypass</a></li><li><a href="/2">New bakery for the old mill</a></li><li><a href="/3">Choir needs tenors</a></li></ol></div></div>
<div class="l-baseline"><p>&copy; The Harbour Gazette. All rights reserved. <a href="/t">Terms</a> <a href="/p">Privacy policy</a></p></div></body></html>""",
        "Ferry returns after repairs The island ferry sailed again on Monday morning after six weeks in the yard, and most of the passengers said they had hardly believed the timetable. “We missed her,” said one of the crew. “The small boat rolled, and nobody on it could drink a cup of tea.” Engineers replaced both engines and a third of the hull plates, at a cost that the council has not yet published. A report is due in spring. The evening sailing will return next week, when the second crew has finished its training.",
    ),
    "blog": (
        """<html><head><title>On sharpening - Bench notes</title></head><body><div id="wrapper"><div id="branding"><a href="/">Bench notes</a><p>Woodwork, slowly</p></div>
<div id="primary"><div class="hentry"><h2 class="hentry-title">On sharpening</h2><p>I sharpen every tool before I put it away, not before I use it. The rule sounds trivial, but it changed how I work.</p>
<p>A dull chisel asks for force, and force is what splits the board. With a keen edge the wood tells you where it wants to go.</p>
<blockquote><p>My teacher said that the stone is the first tool of the bench.</p></blockquote><p>I use three stones, a strop, and no jig at all.</p></div>
<div id="respond-list"><h3>2 replies</h3><ol class="replies"><li><cite>Ana</cite><p>Great post, thanks for writing this one!</p></li><li><cite>Bo</cite><p>I prefer a jig, to be honest, but each to their own.</p></li></ol></div></div>
<div id="secondary"><h3>Archives</h3><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div><div id="colophon">Powered by a small engine</div></div></body></html>""",
        "On sharpening I sharpen every tool before I put it away, not before I use it. The rule sounds trivial, but it changed how I work. A dull chisel asks for force, and force is what splits the board. With a keen edge the wood tells you where it wants to go. My teacher said that the stone is the first tool of the bench. I use three stones, a strop, and no jig at all.",
    ),
    "recipe": (
        """<html><body><header class="site-hd"><a href="/">Plain kitchen</a><nav><a href="/soups">Soups</a><a href="/breads">Breads</a></nav></header>
<div class="recipe-card"><h1>Leek soup</h1><p>A soup for the first cold evening, ready in half an hour, and better on the second day.</p>
<h2>You need</h2><ul><li>three leeks, washed well</li><li>two potatoes, peeled and cut into cubes</li><li>a litre of stock</li><li>salt, pepper and a little cream</li></ul>
<h2>Method</h2><ol><li>Cut the leeks into rings and soften them in butter for ten minutes.</li><li>Add the potatoes and the stock, and simmer until the potatoes fall apart.</li><li>Blend, season, and stir in the cream.</li></ol></div>
<form class="mailer"><label>Get a recipe every week</label><input name=e><button>Sign up</button></form><footer><p>Plain kitchen is written at home.</p></footer></body></html>""",
        "Leek soup A soup for the first cold evening, ready in half an hour, and better on the second day. You need three leeks, washed well two potatoes, peeled and cut into cubes a litre of stock salt, pepper and a little cream Method Cut the leeks into rings and soften them in butter for ten minutes. Add the potatoes and the stock, and simmer until the potatoes fall apart. Blend, season, and stir in the cream.",
    ),
    "tables": (
        """<html><head><title>Valley walks</title></head><body bgcolor=white><table width=100%><tr><td><font size=2><a href=/>Home</a> | <a href=/walks>Walks</a> | <a href=/maps>Maps</a> | <a href=/mail>Mail</a></font></td></tr>
<tr><td><h1>The ridge path</h1><p>The path starts behind the church and climbs through beech woods for an hour, steep at first, then gently along the wall.
<p>On the ridge there is no water, so carry enough for the day. In clear weather the sea can be seen from the third cairn.
<p>Come down by the mill track, which is longer but kinder to the knees.</td></tr>
<tr><td><font size=1>Page made by the valley walkers. Last change in March.</font></td></tr></table></body></html>""",
        "The ridge path The path starts behind the church and climbs through beech woods for an hour, steep at first, then gently along the wall. On the ridge there is no water, so carry enough for the day. In clear weather the sea can be seen from the third cairn. Come down by the mill track, which is longer but kinder to the knees.",
    ),
    "german": (
        """<html lang=de><head><title>Der Wald im Winter</title></head><body><div class="kopfzeile"><ul class="hauptauswahl"><li><a href="/">Startseite</a></li><li><a href="/b">Beiträge</a></li><li><a href="/k">Kontakt</a></li></ul></div>
<div class="hinweis-cookies"><p>Diese Seite verwendet Cookies.</p><button>Einverstanden</button></div>
<div class="beitrag"><h1>Der Wald im Winter</h1><p>Im Winter ist der Wald still, und wer lange genug stehen bleibt, hört den Schnee von den Ästen fallen.</p><p>Die Rehe ziehen am Morgen zum Bach hinunter, denn dort friert das Wasser zuletzt, und unter den Erlen liegt noch Laub.</p><p>Am Abend kehrt man um, bevor der Weg im Nebel verschwindet.</p></div>
<div class="leserstimmen"><h3>Leserstimmen</h3><div class="stimme"><b>Jan</b><p>Sehr schön geschrieben!</p></div></div>
<div class="fusszeile">Impressum <a href="/d">Datenschutz</a></div></body></html>""",
        "Der Wald im Winter Im Winter ist der Wald still, und wer lange genug stehen bleibt, hört den Schnee von den Ästen fallen. Die Rehe ziehen am Morgen zum Bach hinunter, denn dort friert das Wasser zuletzt, und unter den Erlen liegt noch Laub. Am Abend kehrt man um, bevor der Weg im Nebel verschwindet.",
    ),
}
