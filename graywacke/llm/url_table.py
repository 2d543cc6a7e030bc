"""A small labelled table of URLs, written by hand: made-up addresses of kinds of sites, unwanted ones and others."""

from __future__ import annotations

#: Gambling, adult, pharmacy, loan, counterfeit, piracy, link farm and advertising addresses.
UNWANTED = """
http://www.luckyspincasino.net/bonus http://royal-casino-online.org/en/slots http://vegas777casino.net/ https://casinoroyalty.org/play http://bestcasinobonus.net/no-deposit
http://mobilecasino24.org/games http://winbigjackpot.net/slots/free https://jackpotwinners.org/ http://winmoneynow.net/lotto http://megawin-lottery.org/tickets
http://instantwinprize.net/claim?id=7 https://freeprizewinner.org/win http://bet365bonus.net/odds http://sportsbetting-tips.org/football https://bettinghero.net/live
http://freebetoffers.org/signup http://footballbets.net/today http://livebets24.org/in-play https://betkings.net/roulette http://onlinepokerroom.org/texas
http://pokerstarz-free.net/download http://freespins4u.org/slots https://slotmachinefun.net/free-spins http://bingocash.org/play http://roulettesystem.net/win
http://cheapviagra-online.net/buy http://buycialischeap.org/order https://discountpills.net/pharmacy http://canadianpharmacyrx.org/cheap/pills http://dietpills4less.net/
http://weightlosspills.org/free-trial https://cheapmeds-rx.net/no-prescription http://xanaxpills.org/buy http://pillstore24.net/cheap http://steroids-cheap.org/shop
http://cheapreplicawatches.net/rolex http://replicabags-outlet.org/cheap https://cheapnikeoutlet.net/shoes http://fakeid-shop.org/order http://cheapessays.net/write-my-essay
http://adultcamsfree.net/live http://freeadultvideos.org/watch https://adultdating4u.net/ http://hotadultchat.org/rooms http://xxxmovies-free.net/hd
http://sexcams24.org/girls https://pornvideohub.net/xxx http://freepornclips.org/watch http://sexyescorts.net/city http://adultfriends-x.org/join
http://x-rated-pics.net/gallery http://xxxpics.org/ https://hotsexchat.net/adult http://erotic-x.org/stories http://nudeteens.net/xxx
http://adserver1.clickmedia.net/banner.gif https://ads.popunder.org/js/show http://adtracker.net/pixel?id=3 https://trackclicks.org/redirect http://clicktracking.net/t/9
http://bannerads.org/rotate http://ads.doubleserve.net/ad?slot=2 https://trackingpixel.org/p.gif http://popupads.net/show http://adsnetwork.org/serve
http://track.adclicks.net/c?x=1 https://ad-tracking.org/i http://adsyndicate.net/track http://onlineads-server.org/b http://smartadtrack.net/sync
http://spamlinks.net/directory http://linkspam.org/farm https://freelinkfarm.net/add-url http://seo-linkfarm.org/submit http://bulkemailspam.net/lists
http://spammersparadise.org/ http://autospam.net/blast https://articlespinner.org/spam http://farmlinks.net/exchange http://contentfarm.org/articles/9
http://fastcashloans.net/apply https://paydayloan-now.org/cash http://easycreditcash.net/ http://getrichquick.org/free http://workfromhome-cash.net/earn
http://cryptodoubler.org/bitcoin http://freebitcoinmaker.net/claim https://forexprofits.org/signals http://binaryoptionswin.net/trade http://bitcoinbonus.org/double
http://freeiphonewinner.net/survey https://giftcardsurvey.org/free http://freegiftcards.net/claim http://freedownloadcrack.org/serial http://warezcracks.net/keygen
http://freemoviesdownload.org/torrent http://crackedsoftware.net/free https://keygenz.org/warez http://mp3freecrack.net/download http://gamehacks-free.org/cheats
https://blog.superslots.net/en/451 http://m.dailycasino.org/de/1207 http://www.pill-shop.example.org/fr/88 https://m.rx-pills.example.net/en/3302?page=2 http://blog.spam-king.org/es/12
https://www.spam-blast.net/en/7015 http://m.spam-mail.example.org/de/41 https://blog.adult-tube.net/en/96?ref=x http://www.adult-pics.example.org/fr/5 http://m.adult-zone.example.net/es/811
https://adult-chat.org/en/2 http://blog.casino-club.example.org/en/640 https://m.casino-bonus.example.net/fr/19 http://www.casino-king.net/de/7 http://blog.cheap-rolex.example.net/en/31
https://cheap-meds.example.org/es/450?page=2 http://m.cheap-watches.net/en/77 https://www.bets-today.example.net/de/90 http://blog.ads-server.example.org/en/1 https://m.ads-click.net/fr/360
http://spam-traffic.example.net/en/18 https://blog.link-spam.example.net/de/2204 http://diet-pills.example.net/en/9 https://www.lucky-win.org/es/70 http://m.big-win.example.org/en/515
http://cheapflights-scam.net/win http://cheapclickz.org/traffic https://buyfollowers.net/cheap http://buylikes-cheap.org/order http://freetraffic4u.net/clicks
""".split()

#: Papers, schools, shops, clubs, towns, museums, software, recipes and personal pages.
OTHER = """
http://www.harborherald.org/news/2021/05/storm https://dailyledger.net/politics/budget http://morningchronicle.org/opinion/17 https://valleytribune.net/sports/ http://www.eveningpost.org/weather
http://cityuniversity.org/physics/courses https://mathdepartment.net/people/a-turner http://www.oakhillschool.org/calendar https://collegelibrary.net/catalog/search http://openlectures.org/history/12
http://riverside-museum.org/exhibits https://modernartgallery.net/visit http://www.townarchive.org/records/1887 https://naturalhistory.net/fossils/4 http://folkmusicarchive.org/songs
http://gardeningnotes.net/roses/pruning https://thevegetablegarden.org/tomatoes http://birdwatchersclub.net/sightings https://beekeeping.org/hives/spring http://treesofeurope.net/oak
http://grandmasrecipes.org/bread/rye https://soupandstew.net/lentil http://thebakingcorner.org/cakes https://slowcooking.net/beans http://pastaandsauce.org/basil
http://linuxkernelnotes.net/memory https://learnprogramming.org/python/lists http://opensourcedocs.net/install https://databasejournal.org/indexes http://compilerdesign.net/parsing
http://www.mountaintrails.org/maps/north https://cyclingroutes.net/alps http://sailingdiary.org/log/33 https://traintravel.net/stations http://lighthouses.org/coast
http://communityhospital.org/departments https://healthadvice.net/children/fever http://nursingjournal.org/issue/8 https://dentalcare.net/appointments http://firstaidguide.org/burns
http://townhall-brighton.org/meetings https://countycourt.net/forms http://parkservice.org/camping https://publictransport.net/timetable http://waterboard.org/reports/2020
http://chessclub.net/openings/sicilian https://footballleague.org/table http://swimmingteam.net/results https://tennisacademy.org/coaches http://rowing.net/regatta
http://shortstories.org/winter/3 https://poetrymagazine.net/sonnets http://bookreviews.org/novels https://theatrecompany.net/season http://filmsociety.org/classics
http://localbakery.net/opening-hours https://bicycleshop.org/repairs http://furnituremakers.net/chairs https://woolandyarn.org/patterns http://thetoolshop.net/saws
http://astronomyclub.org/planets/saturn https://chemistrylab.net/safety http://geologysociety.org/rocks https://marinebiology.net/corals http://weatherstation.org/data/rain
http://languageschool.net/french/verbs https://dictionary.org/words/there http://translationnotes.net/german https://linguistics.org/phonology http://englishgrammar.net/tenses
http://annasblog.net/2019/03/moving https://theothershore.org/diary http://petersnotebook.net/en/thoughts https://ourfamilytree.org/miller http://inthehills.net/walks
http://interiordesign.org/kitchens https://architecture.net/bridges http://houseandhome.org/roofing https://energysaving.net/heating http://waterandsoil.org/wells
http://financeministry.org/statistics https://economicsreview.net/trade http://insuranceguide.org/house https://taxadvice.net/forms/b http://cooperativebank.org/branches
http://animalshelter.net/dogs https://horseriding.org/lessons http://aquariumfish.net/plants https://catcare.org/kittens http://veterinaryclinic.net/contact
http://photographytips.org/light https://paintingclass.net/watercolour http://pottery.org/glazes https://woodcarving.net/spoons http://sewingroom.org/quilts
http://radiostation.net/schedule https://orchestra.org/concerts/9 http://jazzclub.net/tonight https://choir.org/rehearsals http://pianolessons.net/scales
http://m.northernstar.org/en/451 https://blog.theeditor.net/de/1290 http://www.instrument.org/fr/77?page=2 https://blog.stonehouse.net/es/302 http://m.otherwise.org/en/9004
http://www.green-valley.example.org/en/64 https://blog.tea-house.example.net/fr/1044 http://m.city-guide.example.org/de/9 https://www.old-books.example.net/en/230?page=2 http://blog.night-sky.example.org/es/67
https://m.sea-shore.example.net/en/3880 http://www.farm-school.example.net/en/5 https://blog.farm-animals.example.org/de/71 http://m.stone-bridge.example.net/fr/418 https://window-shop.example.org/en/20
http://www.advice-line.example.net/en/907 https://blog.alphabets.example.org/de/33 http://m.adventure-park.example.net/en/12 https://winter-walks.example.org/es/508 http://blog.headlands.example.net/en/6
http://northsea.net/de/4 https://heathland.net/es/1200?page=2 http://m.hanover.net/de/310 https://ontario.example.net/fr/7 http://thanet.example.net/en/81
https://m.oriental.net/es/44 http://www.inlet.example.org/de/5190 https://estate.example.net/es/3 http://m.littleton.example.net/de/66 https://blog.ireland.net/en/29
http://thinline.net/en/3 https://www.ethernet-notes.org/fr/12 http://blog.northland.net/de/88 https://m.heather.org/es/510 http://www.institution.net/en/6620
""".split()


def labelled_urls() -> list[tuple[str, int]]:
    """(url, label): 1 for unwanted."""
    return [(u, 1) for u in UNWANTED] + [(u, 0) for u in OTHER]
