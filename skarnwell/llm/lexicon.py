"""Terms, word classes and patterns of abusive, hateful and sexual language, and of the contexts that excuse them.

Fixed values, in plain text. A line is "category weight: entries"; entries are separated by commas. In a pattern "_"
stands for up to four words and "@name" for any word of a class. A sentence is a case from a total of 1.0. The words
are listed so that texts that use them can be found and excluded.
"""

TERMS = """
abusive 1.0: asshole, assholes, arsehole, arseholes, bastard, bastards, bitch, bitches, moron, morons, idiot, idiots, imbecile, imbeciles, cretin, cretins, halfwit, halfwits, dimwit, dimwits, dumbass, dumbasses, jackass, scumbag, scumbags, shithead, dickhead, motherfucker, motherfuckers, cunt, cunts, twat, wanker, wankers, prick, douchebag, retard, retards, dumbfuck, bonehead, numbskull, numskull, lowlife, nitwit, dunce, simpleton, dipshit, fuckwit, tosser, bellend, arselicker, fuckface, fucker, fuckers, cocksucker, shitbag, pisshead, crackhead
abusive 0.7: scum, loser, losers, bollocks, bullshit, fuck, shit, crap, whore, whores, slut, sluts, hag, skank, pig, filth
abusive 0.4: stupid, dumb, worthless, useless, pathetic, disgusting, miserable, brainless, filthy, ugly, lazy, incompetent, spineless, braindead, pitiful, repulsive, revolting, clueless, garbage, trash
abusive 1.0: arschloch, arschlöcher, vollidiot, vollidioten, hurensohn, schlampe, missgeburt, wichser, fotze, dummkopf, trottel, drecksau, scheißkerl, drecksack, mistkerl, spast, vollpfosten
abusive 0.4: fresse, dummer, dumme, dummes, wertloses, wertloser, wertlose, dreckige, dreckiger, schwachkopf
abusive 1.0: connard, connards, connasse, salope, salopes, enculé, imbécile, imbéciles, crétin, crétins, abruti, abrutis, bouffon, salaud, ordure
abusive 0.4: gueule, cervelle, inutile, minable
abusive 1.0: imbécil, gilipollas, cabrón, cabrones, pendejo, pendejos, idiota, idiotas, capullo, subnormal, maricón
abusive 0.7: mierda, puta, estúpido, estúpida, zorra
abusive 0.4: inútil, asqueroso, asquerosa
hateful 1.0: subhuman, subhumans, untermensch, untermenschen, nigger, niggers, faggot, faggots, kike, kikes, wetback, wetbacks, raghead, ragheads, towelhead, spic, spics, gook, chink, paki, tranny, kanake, kanaken
hateful 0.6: vermin, ungeziefer, abschaum, vermine, racaille, escoria, alimañas
sexual 1.0: porn, porno, orgy, orgies, dildo, dildos, masturbate, masturbates, masturbating, horny, blowjob, blowjobs, cumshot, milf, tits, pussy, fucking, handjob, gangbang, threesome, creampie, deepthroat, hentai, camgirl, grope, groping, fondle
sexual 0.6: nude, nudes, naked, xxx, fetish, hookup, penis, vagina, breasts, boobs, orgasm, cock, dick, erection, hardcore, moaned, moaning, moans, groaning, undressed, stripper, cum, panties, nipples, thighs, aroused, seduced, topless
sexual 0.5: sex, breast, bra, oral, erect, uncensored, stripped, licked, licking, strip, lingerie, kinky, erotic, webcam
sexual 0.3: explicit, dirty, girls, hips, wet, sweating, pictures, photos, pics, clips, naughty, tonight
sexual 1.0: nacktbilder, ficken, titten, muschi, schwanzlutscher
sexual 0.5: geil, geile, geiler, nackt
sexual 1.0: nichons, branler, sodomie
sexual 0.6: nues, nue, excité, excitée
sexual 1.0: follar, tetas, pajas, coño
sexual 0.6: desnuda, desnudo, desnudas, cachonda, cachondo
sexual 0.4: caliente
"""

#: Words of which any may stand in a place of a pattern.
CLASSES = """
vile: disgusting, worthless, pathetic, vile, useless, miserable, filthy, repulsive, wretched, despicable
insult: stupid, dumb, ugly, lazy, incompetent, brainless, spineless, clueless, fat, thick, ignorant, rotten
being: creature, creatures, person, human, being, specimen, excuse
hurt: kill, murder, finish, stab, shoot, beat, smash, break, crush, slit, cut, punch, strangle, choke, rip, kick, cripple
body: teeth, face, neck, legs, leg, fingers, arms, bones, throat, skull, head, knees, jaw, nose, ribs
suffer: die, choke, rot, suffer, burn, drown, bleed, starve
air: air, space, oxygen, breath, skin
high: bridge, cliff, roof, building, balcony
like: likes, wants, loves, needs, misses
beast: animals, beasts, vermin, parasites, cockroaches, roaches, rats, pigs, dogs, monkeys, apes, savages, insects, maggots, lice, leeches, filth, scum, plague, disease, cancer, pest, criminals, rapists, thieves
filthy: filthy, dirty, disgusting, stinking, inferior, lazy, greedy, rotten
kind: race, people, blood, breed, tribe, families, religion, immigrants, migrants, refugees, foreigners, parasites, animals, savages
expel: deport, expel, exterminate, eradicate, gas, lynch, enslave, sterilize, drown, hang
ban: driven, thrown, kicked, chased
place: country, schools, school, land, town, neighbourhood, neighborhood, nation, streets
home: shops, homes, houses, stores, churches, mosques, temples, villages
rights: rights, mercy, jobs, citizenship, respect, dignity
gone: vanished, disappeared, died, drowned
picture: photos, pictures, pics, nudes, photo, picture, selfies, videos, shots, clips
bare: naked, nude, topless, undressed, nak, explicit, uncensored, dirty
act: sex, intercourse
low: trash, garbage, filth, crap, dirt
he: he, she, they, him, her, you, me
her: her, his, my, your, their
undress: bra, panties, clothes, shirt, dress, underwear
family: family, mother, children, kids, wife
"""

PATTERNS = """
abusive 1.0: kill yourself, kys, hang yourself, go to hell, rot in hell, burn in hell, fuck off, fuck you, piss off, eat shit, piece of shit, full of shit, son of a bitch, sons of bitches, waste of @air, i will find you, i will kill you, gonna kill you, i will @hurt you, @hurt your @body, @hurt _ your @body, know where you live, watch your back, hope you @suffer, hope _ @family @suffer, nobody @like you, no one @like you, dropped on your head, jump off a @high, shut your mouth, shut the fuck up, shut up you, suck my, piss on your, piss on you, lick my, you should be @ban, has the brain of a, have the brain of a, should be beaten, drop dead, makes everyone sick, makes me sick, makes us sick
abusive 0.4: get lost, you are a, you little, smell like
abusive 0.6: piece of @low, shut up, never come back, you will regret, better off without, everyone would be happier, the world would be better, you are so, you are such, you are nothing, you fat, you ugly, too thick to, too stupid to, too dumb to, brain of a, brains of a, @vile @being, come to your house, as @vile as you, as @insult as you, someone should @hurt, crawl back, stinks of, your whole family, hope you lose, like you should, cry somewhere else, stay away from me, ugly @beast, you @filthy, screw you
abusive 1.0: halt die fresse, halt die klappe, halt dein maul, verpiss dich, fick dich, leck mich, geh sterben, scher dich zum teufel, du dreckige
abusive 0.5: soll verschwinden, du dummer, du dumme, du bist so, hau ab
abusive 1.0: ferme ta gueule, ta gueule, sans cervelle, va te faire foutre, va te faire, nique ta, fils de pute, sale con, casse toi
abusive 0.4: espèce de, espèce d, pauvre
abusive 1.0: hijo de puta, vete a la mierda, de mierda, cierra la boca, que te jodan, chinga tu madre, vete al infierno
abusive 0.5: eres un, eres una
abusive 1.0: đồ ngu, câm mồm, khốn nạn, đồ chó, óc chó, con đĩ, đồ khốn, mẹ mày, thằng ngu, thằng khốn, con điên, đồ điên, ngu như bò
abusive 0.5: biến đi, vô dụng, thằng, cút đi
hateful 1.0: go back to your country, go back where _ came from, @ban out of _ @place, out of our @place, inferior race, inferior people, master race, @filthy @kind, @expel them all, wipe them out, kick them out, get rid of them, throw them out, they are @beast, they are all @beast, they are nothing but @beast, people are @beast, migrants are @beast, immigrants are @beast, foreigners are @beast, women are @beast, are @beast not humans, not humans, do not deserve @rights, not deserve @rights, burn their @home, burn down their @home, breed like, only good for breeding, if they all @gone, they all @gone, white power, no _ no dogs, should never have been born, being born among, gas the, death to all, they should all be, not belong here
hateful 0.6: stinks of their, refuse to sit next to, refuse to work with, should be illegal, sink the, let them @suffer, people @suffer, finish off the
hateful 0.4: by nature, their kind, your kind, real citizens, our women, who cares, one less, never hire, should be a crime
hateful 1.0: sind ungeziefer, gehören verjagt, gehören vergast, gehören abgeschoben, ausländer raus, ist abschaum, sind abschaum, sind tiere, alle abschieben
hateful 1.0: de la vermine, sont des animaux, sont des parasites, les chasse tous, chassez les tous, sales étrangers, dehors les étrangers, retourne dans ton pays, sale race
hateful 1.0: son ratas, son animales, son escoria, hay que echarlos, hay que expulsarlos, fuera de nuestro país, vuelve a tu país
hateful 1.0: lũ sâu bọ, lũ súc vật, lũ chuột, đuổi hết, bọn mọi, cút về nước
hateful 0.5: sâu bọ, súc vật
sexual 1.0: jerk off, jerking off, cam show, sex tape, had @act, have sex with, @act with me, begged for @act, take off your @undress, take off her @undress, moaned as @he, licked her, licked his, sucked his, @bare @picture, @picture _ naked, send nudes, show me your tits, show me your body, i came, ride my, on top of me, live sex, sex chat, one night stand, friends with benefits, escort service, sleep with me, take you to bed, get you in bed, get you into bed, get into your pants
sexual 0.6: adults only, no strings, no strings attached, show me everything, take off your, so horny, pressed against @her, sex partner, hot girls, girls next door, oral first, wet for, explicit shots, touch yourself
sexual 1.0: blas mir einen, heiße nackte, geile bilder
sexual 0.5: schick mir
sexual 1.0: photos nues, photo nue, suis trop excité, fais moi l'amour
sexual 0.5: envoie moi
sexual 1.0: fotos desnuda, fotos desnudo, estoy muy caliente, estoy cachondo
sexual 0.4: mándame fotos
sexual 1.0: ảnh khỏa thân, ảnh nóng, đang nứng, làm tình, địt nhau, quan hệ tình dục với anh
sexual 0.6: khỏa thân
"""

#: Words that speak of rules about language, of reports, law, medicine, animals or works: near them a term is spoken of, not used.
MENTIONS = """
policy, policies, guideline, guidelines, prohibit, prohibits, prohibited, forbid, forbids, forbidden, tolerated, harassment, moderation, moderator, moderators, classifier, classifiers, flagged, slur, slurs, insult, insults, insulting, complaint, complaints, court, lawsuit, verdict, defendant, statute, dictionary, glossary, etymology, novel, poem, opera, film, bestseller, playwright, author, chapter, veterinarian, veterinary, puppies, litter, kennel, breeder, lyrics, censored, apologised, apologized, richtlinie, verboten, beleidigung, interdit, insulte, prohibido, insulto
"""

#: Verbs and nouns that name a word instead of using it, when a term follows within a few words.
CALLING = """
call, calls, called, calling, calls, labelled, labeled, labelling, word, words, term, terms, nennen, genannt, traiter, llamar
"""

#: Verbs of speech: next to a passage in quotation marks they make it someone else's.
SPEECH = """
said, says, wrote, writes, called, shouted, shouts, yelled, told, replied, tweeted, posted, quoted, quotes, reads, read, titled, entitled, named, testified, alleged, reported, documents, example, examples, sagte, schrieb, dit, écrit, dijo, escribió
"""

#: Words of technical, medical or legal use: near them weak terms count less.
EXCUSES = """
filter, filters, flags, detector, review, report, reported, reports, rule, rules, banned, trial, cancer, screening, clinic, clinical, patient, patients, diagnosis, medical, anatomy, surgeon, census, survey, column, columns, demographic, domain, domains, process, processes, daemon, node, nodes, folder, capacitance, terminal, testing, penetration, training, curriculum, vaccine, therapy, valve, valves, nut, nuts, bolt, bolts, screw, screws, wire, wires, thread, threads, gear, gears, biology, species, habitat, virus, symptoms
"""

#: Plain words of the languages here that are one edit from a term; only as they stand, never a misspelling of it.
ORDINARY = """
that, than, what, chat, swat, twit, count, aunt, hunt, runt, morning, mourning, meaning, loaning, seit, shift, shot, ship, shut, shirt, sheet, short, skit, slit, suit, port, pork, born, corn, torn, horn, horns, form, worn, boots, books, crab, clap, crop, cramp, wrap, scrap, duck, deck, dock, docks, lick, luck, rock, sock, lock, cook, cork, clock, disk, brick, price, pride, pick, trick, witch, batch, beach, pitch, ditch, bench, birch, switch, fetch, latch, patch, bastion, custard, mustard, retire, reward, regard, tardy, dummy, dumme, track, trace, cash, crash, brash, trans, tracks, hug, bag, tag, slug, shut, slot, slots, slum, sham, scam, swim, spam, stem, lose, loser, losses, close, user, users, chinks, chunk, chunks, think, chin, spice, spec, specs, spin, spit, split, cult, cut, cute, cuts, curt, court, bust, boost, boots, booth, bob, bobs, tips, tits, tots, ties, times, type, types, nude, node, nodes, none, note, notes, nuke, rude, mode, naked, named, maker, baked, staked, pussy, push, fussy, bussy, organ, organs, orgs, order, horse, hoary, honey, stupor, filth, fifth, firmly, lazily, lady, laxy, ugly, useful, garage, message, vermin, termin, mist, most
"""
