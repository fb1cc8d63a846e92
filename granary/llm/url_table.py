"""The labelled URLs that the URL classifier learns from: names of many kinds, in the shapes in which hosts carry them.

Every name stands alone and beside neutral words, before registered endings and below other sites' domains, under ordinary
paths. Both labels get the same neutral words, endings and paths, so only the names tell them apart. Paths of unwanted pages
stand below good names. Good names hold many that share letters with bad ones (essex, specialist, spillway, alphabet).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Names of unwanted sites by kind.
BAD = {
    "gambling": "casino casinos poker slots bets betting sportsbet roulette jackpot blackjack bingo lottery gambling wager apuestas "
                "wetten bookmaker spins bet freebet betonline onlinecasino",
    "adult": "adult adultchat xxx porn sex sexcam escort nude erotic webcamgirls hookup milf fetish hotgirls",
    "pharmacy": "pills meds pharmacy viagra cialis xanax tramadol rxmeds painkillers steroids weightloss slimming drugstore pill dietpills sleepingpills medstore",
    "money": "payday payday-loan quickloan cashloan fastcash easycash getrich forex-signals cryptodouble bitcoin-doubler binaryoption",
    "piracy": "warez crack cracked keygen serialz torrents nulled freemovies streamrip romhacks",
    "spam": "spam spammer linkfarm link-exchange backlinks seoboost bulkmail spambot spamlist clickbait doorway articlespin",
    "ads": "ads adserver adserv adstats adsnetwork adtrack adclick tracker tracking clicktrack popunder popads affiliate doubleads banners pixeltag",
    "fraud": "phish phishing secure-login verify-account account-update freegift prizewinner giveaway-claim replica fakewatches malware "
             "hacktool",
}
#: Names of ordinary sites by kind; the last kinds share letters with bad names or are neutral words of their own.
GOOD = {
    "news": "news herald gazette tribune courier chronicle observer reporter zeitung diario journal telegraph weekly radio",
    "learning": "university college school academy institute library wiki encyclopedia dictionary lectures physics chemistry "
                "mathematics history philosophy biblioteca universidad hochschule lycee archive",
    "public": "council parliament ministry city police hospital clinic museum court embassy census weather transport railway rathaus "
              "mairie ayuntamiento",
    "trade": "bakery garden furniture shoes bicycle kitchen flowers plumber carpenter builder insurance bank hotel restaurant winery "
             "optician bookshop toys electric logistics engineering consulting architects lawyers",
    "leisure": "travel recipes football tennis theatre cinema concert orchestra festival hiking sailing fishing camping photography "
               "painting knitting birdwatching chess running yoga",
    "technology": "software docs developer opensource linux python cloud database forum hosting mail status network robotics "
                  "semiconductor github-mirror",
    "people": "smith martin garcia mueller rossi johnson family thompson anderson reilly hernandez brother mother children parents "
              "neighbours",
    "places": "london berlin madrid paris toronto north south river mountain valley lakeside harbour island forest coast bridge "
              "station heath northern thames",
    "common words": "about after against almost always animal answer autumn balance because before between breakfast business change "
                    "children colour common company country culture design different early energy england europe evening every "
                    "express final first fresh friend future general global golden green handmade health heritage holiday human image "
                    "important international island kingdom language large leader letter light little living local magazine market "
                    "matter member memory modern moment morning nation nature notice number office origin pattern people personal "
                    "picture planet point popular position power present project public quality question reason record region research "
                    "result return review royal season second service silver simple small social society sound special spring standard "
                    "story strategy stream street student studio summer system table teacher thought together tomorrow tradition "
                    "training union value village vision voice water window winter within without women wonder world writer young",
    "other languages": "arbeit freiheit gesundheit zeit wissenschaft bildung haus garten kinder leben musik reise schule stadt verein "
                       "agua amigos ciudad cultura educacion empresa gente historia mundo noticias nuestra tiempo trabajo viajes vida "
                       "amis bonjour cuisine eau ecole enfants jardin journal lumiere maison monde nouvelle pays recherche sante soleil "
                       "terre vacances ville voyage",
    "near gambling": "alphabet alphabets elizabeth diabetes betsy tibet pokemon slovenia casimir cassette sloth betterhomes beta bottles",
    "near adult": "essex sussex middlesex adultlearning adulthood pornic exxon taxonomy sexton escorial denuded",
    "near pharmacy": "spillway caterpillar pillar pillow specialist medieval media medical mediation pharmacology "
                     "drugresearch pilgrim",
    "near money": "paydayparade cashmere cashew loanword cryptography forestry",
    "near ads": "roads loads downloads beads heads threads shades adsorption address tractor attraction tracklist railtrack headsets",
    "near spam": "spaniel sparrow linkedcare linking clickable crackers craquelure",
    "near fraud": "phonetics philharmonic verification accounting gifted giftwrap prizes malwa replication",
}
#: Words that say nothing by themselves; they stand beside names of both labels.
NEUTRAL = ("best", "free", "online", "shop", "my", "club", "world", "24", "win", "top", "new", "cheap", "direct", "plus", "house", "the",
           "group", "center", "now", "x", "pro", "star", "blue", "farm", "track", "chat")
#: What stands behind a name: a public suffix, so that the name is the registered one, or another site's domain.
ENDINGS = ("com", "org", "net", "info", "de", "fr", "es", "it", "co.uk", "io", "eu", "com.br", "ru", "webspace.com", "hosting.org",
           "homepage.net", "pages.io", "cloudsite.eu", "myserver.de", "portal.fr", "users.provider.co.uk", "ciudad.es", "sites.info")
FRONTS = ("", "www.", "m.", "blog.", "")
#: Paths of ordinary pages, and of unwanted ones.
PATHS = ("/", "/en/1234", "/fr/77.html", "/de/5210/", "/es/9?page=2", "", "/about", "/2021/05/a-day-at-the-lake.html", "/wiki/Main_Page",
         "/contact.php", "/products/item-12", "/index.html#top", "/blog/posts/418/", "/search?q=map", "/docs/guide/install",
         "/images/photo.jpg", "/x", "/a/b/c", "/p?id=1", "/news/local", "/extra/index")
BAD_PATHS = ("/buy-viagra-online", "/casino/bonus.html", "/ads/click.php", "/affiliate/track/pixel.gif", "/adserver/banner.js",
             "/online-poker/free-spins", "/xxx/webcam.html", "/warez/keygen.zip", "/secure-login/verify-account.php", "/cheap-meds/order",
             "/spam/linkfarm.html", "/payday-loans/apply", "/free-gift/claim-prize", "/porn/index.html", "/torrents/cracked/")


#: Ordinary names as others' domains, below which names of both labels stand.
DOMAINS = tuple(w for words in GOOD.values() for w in words.split())


def shapes(name: str, k: int, neutral: tuple[str, ...] = NEUTRAL) -> Iterator[str]:
    """The name alone, beside four neutral words, with and without a hyphen, and so below ordinary domains."""
    a, b, c, d = (neutral[(5 * k + 7 * i) % len(neutral)] for i in range(4))
    e, f, g = (DOMAINS[(11 * k + 131 * i) % len(DOMAINS)] for i in range(3))
    yield from (name, f"{a}-{name}", f"{name}-{b}", f"{c}{name}", f"{name}{d}", f"{name}.{e}", f"{name}-{d}.{f}", f"{b}-{name}.{g}")


def labelled(
    taken: Callable[[str], bool] = lambda name: True, neutral: tuple[str, ...] = NEUTRAL, endings: tuple[str, ...] = ENDINGS,
) -> list[tuple[str, int]]:
    """(url, bad) of the names that are taken, with these neutral words and endings; a bad name stands before two
    endings in each shape, another before one, because there are fewer of them. Splits by names or by neutral words and endings hold whole words out."""
    rows = []
    for bad, kinds in ((1, BAD), (0, GOOD)):
        for k, name in enumerate(w for words in kinds.values() for w in words.split() if taken(w)):
            for j, host in enumerate(shapes(name, k, neutral)):
                for r in range(1 + bad):
                    n = 16 * k + 2 * j + r
                    site = f"http{'s' * (n % 2)}://{FRONTS[n // 2 % len(FRONTS)]}{host}.{endings[n * 3 % len(endings)]}"
                    rows.append((site + PATHS[(n + k) % len(PATHS)], bad))
                    if not bad and (j + k) % 8 == 0:
                        rows.append((site + BAD_PATHS[n // 2 % len(BAD_PATHS)], 1))
    return rows
