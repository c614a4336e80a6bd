"""Weighted terms of abusive, hateful and sexual language, and of contexts that excuse them.

One line per language and role: ``lang role: term=weight ...``; a term without a weight has 1.  Roles:
ab insults and threats, to words that address someone, sx sexual acts and display, gr groups of people,
ht hostility towards a group, and ex contexts (reports, medicine, technology, animals, play).
"""

LEXICON = """
en ab: idiot=1 idiots=1 moron=1 morons=1 cretin=1 imbecile=1 bastard=1 bastards=1 asshole=1.2 arsehole=1.2 scumbag=1.2 scum=1 bitch=1.1 whore=1 slut=1 cunt=1.3 dickhead=1.2 wanker=1.1 jerk=.6 loser=.7 freak=.6 retarded=1 pig=.7 swine=.7 garbage=.6 trash=.6 worthless=.8 filthy=.5 brainless=.8 stupid=.7 dumb=.6 ugly=.7 pathetic=.7 miserable=.5 disgusting=.5 lying=.3 liar=.5 shitty=.8 bullshit=.7 fuck=.9 fucking=.6 shut=.4 mouth=.3 choke=.9 crawl=.6 hole=.3 disappear=.6 favour=.2 favor=.2 hope=.2 truck=.5 hit=.3 beating=.8 break=.4 finger=.6 fingers=.6 bones=.6 hands=.2 sorry=.5 posting=.3 house=.3 find=.2 make=.1 miss=.4 gone=.5 nobody=.3 piece=.3 die=.1 rot=.7 kill=.6 killed=.5 hurt=.5 punch=.6 strangle=.9 stab=.9 drown=.6 hell=.3 opinion=.2 asked=.1 claim=.2 burn=.4 hang=.3
en to: you your yours yourself u
en sx: fuck=.7 fucked=1 fucking=.7 fucks=.8 cock=1 dick=.8 pussy=1 cunt=.6 nipples=1 nipple=.9 moaned=.9 moaning=.9 moans=.8 naked=.7 nude=.6 sex=.6 breasts=.6 tits=1 boobs=.9 suck=.6 sucked=.6 sucking=.7 swallow=.5 blowjob=1.2 orgasm=.9 cum=.9 came=.3 erection=.8 horny=1 porn=.9 xxx=.8 thrust=.6 licked=.6 tongue=.3 legs=.3 spread=.3 sweaty=.4 slid=.3 hard=.2 dress=.3 climbed=.3 pulled=.2 top=.1 couples=.3 camera=.3 tonight=.2 watch=.2 live=.2 hot=.3 floor=.1 finished=.2 stiffened=.6 stripped=.4 undressed=.6 masturbate=1.1
en gr: women men immigrants migrants refugees foreigners gays gay lesbians disabled old jews muslims christians blacks arabs asians gypsies cripples people=.3 islanders=1 folk=.5 tribe=.5 they=.2 them=.3
en ht: vermin=1.1 parasites=1 rats=.8 cockroaches=1 animals=.5 filthy=.5 pack=.4 lot=.2 thieves=.9 thief=.4 criminals=.6 driven=.6 drive=.3 town=.3 lock=.8 locked=.6 cleaner=.9 place=.2 world=.2 without=.3 deserve=.4 rights=.4 same=.2 normal=.3 not=.2 send=.5 back=.2 ruin=.7 never=.3 let=.2 shop=.2 keep=.3 away=.5 children=.3 throw=.7 out=.2 moved=.3 nothing=.1 works=.1 deport=.9 exterminate=1.3 gas=.5 expel=.8 ban=.4 dumb=.5 lazy=.7 stupid=.5 inferior=.9 every=.1 last=.2 all=.1 too=.2
en ex: clinic=1 clinics=1 doctor=.8 medical=1 health=1 cancer=1 cervical=1 contraception=1.2 condom=.6 advises=.6 checks=.4 screening=.8 exam=.6 patients=.8 process=1.2 processes=1 parent=.5 abort=.7 job=.4 thread=.6 shed=.8 tool=.5 waiter=1 file=.5 rooster=1.4 donkey=1.2 hen=1 stubborn=.3 moderators=1.6 moderator=1.6 remove=.6 removes=.6 delete=.6 deletes=.6 insults=.6 insult=.4 paper=.5 counts=.5 measures=.6 speech=.6 logs=.5 threats=.5 report=.7 reports=.7 boss=.8 game=.6 laughing=.8 laughed=.8 message=.5 seat=.7 quoted=.8 court=.6
de ab: idiot=1 idioten=1 trottel=1 depp=1 vollidiot=1.2 arschloch=1.2 arsch=.7 wichser=1.2 abschaum=1.1 dreck=.6 drecksau=1.2 sau=.6 schwein=.7 missgeburt=1.3 hurensohn=1.4 schlampe=1.1 elendes=.6 elender=.6 erbärmlicher=.7 erbärmliche=.7 dummes=.6 dumm=.6 hässlich=.7 maul=.9 halt=.2 verpiss=1.2 beschissene=.9 beschissenes=.9 scheiß=.7 erstickst=.9 ersticken=.7 hoffentlich=.3 letzte=.2 verrecke=1.3 bereuen=.8 finde=.3 haus=.2 vermissen=.6 verschwinde=.6 verschwindest=.6 fehlen=.3 finger=.5 brechen=.6 niemand=.3 keiner=.3 wertlos=.7 wertloser=.7 müll=.6 hirnloser=.9 krepier=1.2 laster=.4 überfährt=.6 lkw=.4 schreib=.2 meinung=.2 loch=.3 kriech=.6 hirnlose=.9 fresse=.9 lügner=.6 verlogenes=.7 prügel=.8 gefallen=.2 weg=.2
de to: du dein deine deinen deinem dich dir euch ihr
de sx: ficken=1.2 fickt=1.1 gefickt=1.1 fickte=1.1 schwanz=1 muschi=1 fotze=1 titten=1.1 brüste=.5 nippel=1 brustwarzen=.9 stöhnte=.9 stöhnen=.8 nackt=.7 nackte=.7 nackten=.7 geil=.7 blasen=.5 lutschen=.8 lutschte=.8 sex=.6 orgasmus=.9 paare=.3 kamera=.3 live=.2 nacht=.1 kleid=.3 zog=.2 setzte=.2 kam=.3 kamen=.3 leckte=.6 stieß=.5 schau=.2 porno=.9 spritzte=.8 schob=.3 beine=.3 steif=.4 zunge=.3
de gr: frauen männer einwanderer flüchtlinge ausländer migranten schwule lesben behinderte alte juden muslime christen schwarze zigeuner leute=.5 bewohner=.6
de ht: ungeziefer=1.1 parasiten=1 ratten=.8 gejagt=.6 stadt=.2 gehören=.3 einsperren=1 miteinander=.2 alle=.1 sauberer=.9 ohne=.2 welt=.2 verdienen=.4 rechte=.4 gleichen=.2 normale=.3 nicht=.2 diebe=.9 kinder=.2 fern=.4 haltet=.3 zurück=.4 schickt=.5 ruinieren=.6 dumm=.6 faul=.8 zu=.05 tiere=.5 dreckige=.6 dreckiges=.6 pack=.7 laden=.2 nie=.2 lasse=.2 lass=.2 schmutzige=.5 rauswerfen=.8 werft=.6 raus=.5 abschieben=.9 vergasen=1.4 sollte=.2 man=.1 kaputt=.4
de ex: praxis=1 gesundheit=1 sexuelle=.4 brustkrebs=1.3 arzt=.8 klinik=1 elternprozess=1.5 kindprozess=1.5 prozess=1 moderation=1.6 löscht=.8 beitrag=.5 beleidigt=.6 hassrede=.8 hahn=1 esel=1 spiel=.6 lachen=.6 gelacht=.6 vorsorge=.8 verhütung=1.2
es ab: idiota=1 imbécil=1.1 estúpido=.9 estúpida=.9 cabrón=1.2 gilipollas=1.2 hijo=.2 puta=.9 puto=.8 mierda=.8 basura=.7 escoria=1.1 desgraciado=.9 maldito=.7 maldita=.7 patético=.7 asqueroso=.6 asquerosa=.6 cerdo=.7 inútil=.7 feo=.6 tonto=.6 boca=.3 cierra=.4 calla=.5 atragantes=1 ojalá=.4 muérete=1.3 muere=.7 vete=.4 joder=.6 jódete=1.2 casa=.2 arrepentir=.8 arrepentirás=.9 arrepentirte=.8 encontraré=.5 encontrar=.2 echaría=.5 menos=.1 nadie=.3 desaparecieras=.7 desaparece=.6 dedos=.5 romper=.5 romperte=.6 manos=.2 humana=.4 opinión=.2 pidió=.1 camión=.5 atropelle=.7 paliza=.8 mentiroso=.6 capullo=1 mamón=.9 subnormal=1.1 publicando=.3 escribiendo=.2
es to: tú tu tus te ti eres vos usted
es sx: follar=1.1 follando=1.1 follaron=1.1 polla=1.1 verga=1.1 coño=.9 tetas=1.1 pechos=.4 pezones=1 desnudas=.7 desnudos=.7 desnuda=.7 desnudo=.6 gimió=.9 gemía=.9 gemir=.8 correrse=1.1 corrió=.3 chupó=.8 chupar=.7 metió=.4 acabaron=.4 parejas=.3 directo=.2 noche=.1 vestido=.3 quitó=.2 montó=.4 míralo=.3 lamió=.7 sexo=.5 orgasmo=.9 porno=.9 mamada=1.2 lengua=.3 piernas=.3
es gr: mujeres hombres inmigrantes refugiados extranjeros gays homosexuales lesbianas discapacitados ancianos viejos judíos musulmanes cristianos negros gitanos moros gente=.3
es ht: plaga=1 parásitos=1 ratas=.8 echarlos=.7 echar=.4 pueblo=.2 habría=.3 encerrar=.9 limpio=.8 sin=.2 mundo=.2 merecen=.4 derechos=.4 mismos=.2 normal=.3 ladrones=.9 niños=.2 lejos=.4 animales=.5 asquerosos=.7 tienda=.2 nunca=.3 dejo=.2 entrar=.2 tontos=.5 vagos=.8 demasiado=.3 todos=.1 expulsar=.8 deportar=.9 sucios=.5 arruinen=.6 vuelvan=.4 devolver=.3 país=.1 no=.2 estaría=.2 más=.1 son=.1
es ex: clínica=1 salud=1 sexual=.3 cáncer=1.2 mama=.6 médico=.8 proceso=1.2 padre=.4 aborta=.6 tarea=.4 moderadores=1.6 borran=.8 comentario=.5 insulte=.6 gallo=1 burro=1 juego=.6 risa=.8 jefe=.5 partida=.4
fr ab: idiot=1 idiote=1 imbécile=1.1 crétin=1.1 connard=1.3 connasse=1.2 con=.7 salaud=1.1 salope=1.1 pute=.9 merde=.8 ordure=1 ordures=.8 déchet=.8 raclure=1.1 sale=.4 pauvre=.4 gueule=1 ferme=.4 étouffer=.9 espère=.4 foutre=1 enculé=1.3 dégage=.8 crève=1.2 crever=1 minable=.8 débile=.9 moche=.6 laid=.6 bête=.4 camion=.5 écrase=.5 raclée=.8 menteur=.6 avis=.2 personne=.2 manquerais=.6 manquer=.4 disparaissais=.7 disparais=.6 doigts=.5 casser=.5 briser=.5 retrouverai=.7 retrouver=.3 regretter=.7 regretteras=.8 maison=.2 continue=.2 porc=.7 stupide=.7 publier=.2 humaine=.2 humain=.2
fr to: tu toi te ton ta tes vous votre
fr sx: baiser=.9 baisent=1.1 baise=.8 bite=1 queue=.5 chatte=.9 seins=.5 tétons=1 nichons=1.1 nus=.7 nues=.7 nue=.7 nu=.4 gémi=.9 gémit=.9 gémissait=.9 jouir=1.1 jouissent=1 jouissance=.8 sucer=.9 suça=.8 sucé=.8 lécha=.7 léché=.7 enfonça=.5 enfoncé=.4 couples=.3 direct=.2 soir=.1 robe=.3 retiré=.2 assise=.2 sexe=.5 orgasme=.9 porno=.9 langue=.2 jambes=.3 venez=.2 voir=.1
fr gr: femmes hommes immigrés migrants réfugiés étrangers gays homosexuels lesbiennes handicapés vieux juifs musulmans chrétiens noirs arabes gitans gens=.3
fr ht: vermine=1.1 parasites=1 rats=.8 chasser=.8 ville=.2 enfermer=.9 faudrait=.3 exception=.1 propre=.8 sans=.2 monde=.2 méritent=.4 droits=.4 mêmes=.2 normaux=.3 pas=.2 voleurs=.9 enfants=.2 loin=.4 animaux=.5 sales=.5 magasin=.2 jamais=.3 laisse=.2 entrer=.2 bêtes=.4 bande=.3 répugnants=.6 paresseux=.7 fainéants=.8 trop=.2 expulser=.8 renvoyer=.5 renvoyez=.5 ruiner=.5 tous=.1 serait=.2 plus=.1 idiots=.4
fr ex: clinique=1 santé=1 sexuelle=.3 dépistage=1.2 médecin=.8 cancer=1 processus=1.4 parent=.3 bloque=.4 modérateurs=1.6 suppriment=.8 message=.4 insulte=.6 coq=1 âne=1 jeu=.6 rire=.8 boss=.6 contraception=1.2
it ab: idiota=1 imbecille=1.1 stronzo=1.3 stronza=1.2 bastardo=1 cretino=1.1 coglione=1.2 merda=.8 feccia=1.1 schifoso=.7 maiale=.7 porco=.6 patetico=.7 maledetto=.7 stupido=.7 brutto=.4 bocca=.3 chiudi=.4 strozzi=1 spero=.4 crepa=1.2 muori=1 fanculo=1.2 vaffanculo=1.2 spazzatura=.8 rifiuto=.7 opinione=.2 nessuno=.3 mancheresti=.7 mancherebbe=.5 sparissi=.7 sparisci=.7 dita=.5 spezzare=.6 rompere=.4 mani=.2 casa=.2 pentirai=.9 troverò=.5 continua=.2 scrivere=.2 camion=.5 investa=.6 botte=.6 bugiardo=.6 umano=.3 cazzo=.3 accorgerebbe=.6
it to: tu tuo tua tuoi tue te ti sei vi
it sx: scopare=1 scopano=1.1 scopando=1.1 cazzo=.8 figa=1 tette=1.1 seni=.4 capezzoli=1 nude=.7 nudi=.7 nuda=.7 nudo=.6 gemette=.9 gemeva=.9 gemere=.8 venire=.2 vennero=.4 venirono=.3 succhiò=.8 succhiare=.7 leccò=.7 coppie=.3 diretta=.2 stanotte=.2 vestito=.3 tolse=.2 sedette=.2 spinse=.4 sesso=.5 orgasmo=.9 porno=.9 guarda=.2 gambe=.3 lingua=.2 fondo=.1
it gr: donne uomini immigrati profughi stranieri gay omosessuali lesbiche disabili anziani vecchi ebrei musulmani cristiani neri zingari gente=.3 quelli=.6
it ht: parassiti=1.1 piaga=1 peste=.9 topi=.6 cacciati=.8 cacciare=.8 cacciarli=.8 città=.2 paese=.1 rinchiudere=.9 bisognerebbe=.3 pulito=.8 senza=.2 mondo=.2 meritano=.4 diritti=.4 stessi=.2 normale=.3 non=.2 ladri=.9 bambini=.2 lontano=.4 animali=.5 luridi=.7 schifosi=.7 sporchi=.5 negozio=.2 mai=.2 lascio=.2 entrare=.2 stupidi=.6 pigri=.8 troppo=.3 tutti=.1 espellere=.8 sarebbe=.2 branco=.4 rovinino=.6
it ex: clinica=1 salute=1 sessuale=.3 prevenzione=1 seno=.3 medico=.8 cancro=1 processo=1.2 padre=.4 blocca=.4 figlio=.2 moderatori=1.6 tolgono=.8 messaggio=.5 insulta=.6 gallo=1 asino=1 gioco=.6 ridere=.8 boss=.6
pt ab: idiota=1 imbecil=1.1 otário=1.1 otária=1.1 babaca=1 desgraçado=1 cretino=1.1 merda=.8 lixo=.8 escória=1.1 porco=.7 patético=.7 burro=.4 feio=.6 nojento=.6 maldito=.7 boca=.3 cala=.5 engasgue=1 tomara=.4 morra=1 foder=.9 foda=.7 puta=.9 filho=.1 corno=.9 vagabundo=.8 opinião=.2 ninguém=.3 falta=.3 sentir=.2 sumisse=.7 suma=.5 some=.2 dedos=.5 quebrar=.5 mãos=.2 casa=.2 arrepender=.8 acho=.2 postando=.3 continua=.2 caminhão=.5 atropelado=.7 surra=.8 mentiroso=.6 humano=.3 estúpido=.7 verme=.8 sabe=.1
pt to: você vc tu seu sua seus suas te ti vocês
pt sx: foder=.6 fodeu=1 transar=.9 transando=1.1 trepar=.9 trepando=1 pau=.9 pica=.9 buceta=1.2 xoxota=1.1 peitos=.7 tetas=1 mamilos=1 pelados=.8 peladas=.8 pelada=.8 nus=.5 nua=.6 gemeu=.9 gemia=.9 gemer=.8 gozar=1.1 gozou=1.1 gozarem=1.1 chupou=.8 chupar=.7 lambeu=.8 meteu=.6 casais=.3 vivo=.1 noite=.1 vestido=.3 tirou=.2 sentou=.2 fundo=.1 sexo=.5 orgasmo=.9 pornô=.9 língua=.2 pernas=.3 venha=.2
pt gr: mulheres homens imigrantes refugiados estrangeiros gays homossexuais lésbicas deficientes idosos velhos judeus muçulmanos cristãos negros ciganos gente=.3
pt ht: praga=1 parasitas=1 ratos=.8 expulsos=.8 expulsar=.8 cidade=.2 deviam=.3 prender=.8 todos=.1 limpo=.8 sem=.2 mundo=.2 merecem=.4 direitos=.4 mesmos=.2 normal=.3 não=.2 ladrões=.9 crianças=.2 longe=.4 animais=.6 imundos=.8 sujos=.5 bando=.4 loja=.2 nunca=.3 deixo=.2 entrar=.2 burros=.6 preguiçosos=.8 demais=.3 são=.1 mais=.1 seria=.2 estraguem=.6 eles=.1
pt ex: clínica=1 saúde=1 sexual=.3 exame=.8 mama=.6 médico=.8 câncer=1.2 processo=1.2 pai=.4 travar=.5 aborte=.6 tarefa=.4 moderadores=1.6 apagam=.8 comentário=.5 ofende=.6 galo=1 jogo=.6 rir=.8 chefe=.6
ru ab: идиот=1 дебил=1.1 урод=1.1 ублюдок=1.3 сволочь=1.2 тварь=1.1 мразь=1.3 подонок=1.2 козёл=.9 козел=.9 дурак=.9 тупой=.7 тупая=.7 мерзкий=.7 мерзкая=.7 жалкий=.7 жалкая=.7 поганый=.8 рот=.3 закрой=.4 заткнись=1 подавился=1 подавилась=1 чтоб=.4 жопу=.9 жопа=.8 дерьмовое=.9 дерьмо=.9 дерьма=.9 говно=1 сука=1.1 сдохни=1.3 сдох=1.1 мусор=.6 отброс=1 ничтожество=1.1 кусок=.3 мнение=.2 никому=.2 никто=.2 пошёл=.4 пошел=.4 пошла=.4 найду=.5 дом=.2 пожалеешь=.9 заметил=.3 исчез=.5 исчезни=.7 пропал=.5 пропала=.5 пальцы=.5 сломать=.5 переломать=.7 руках=.2 пиши=.3 дальше=.2 свинья=.8 грузовик=.5 собьёт=.6 безмозглый=.9 лживый=.6 лжец=.6 уродливый=.7 навсегда=.3 скучать=.5 избить=.8
ru to: ты тебя тебе твой твоё твое твоя твои твоего твоих твоим вы вас ваш
ru sx: трахаются=1.2 трахает=1.1 трахал=1.1 трахать=1.1 член=.8 стонала=.9 стонал=.8 стонать=.8 кончила=.9 кончил=.9 кончили=.9 кончить=.8 голые=.8 голая=.8 голый=.7 грудь=.4 соски=1 сиськи=1.1 раздвинула=.7 лизал=.8 лизнул=.7 сосать=.9 сосала=.9 пары=.3 эфире=.2 ночью=.1 платье=.3 сняла=.2 села=.2 вошёл=.3 секс=.6 оргазм=.9 порно=.9 смотри=.2 ноги=.3 языком=.3
ru gr: женщины женщин мужчины мужчин мигранты мигрантов беженцы беженцев иностранцы иностранцев геи геев лесбиянки инвалиды инвалидов старики стариков евреи евреев мусульмане христиане чёрные цыгане люди=.3 жители=.5 жителей=.5
ru ht: паразиты=1.1 крысы=.8 тараканы=1 гнать=.8 города=.2 замком=.8 сидеть=.3 должны=.2 одного=.1 чище=.9 без=.2 мир=.2 заслуживают=.4 прав=.4 тех=.1 нормальные=.3 не=.2 воры=.9 детей=.2 подальше=.5 держите=.3 животные=.5 грязные=.7 магазин=.2 никогда=.3 пущу=.3 пускаю=.3 тупые=.7 ленивые=.8 слишком=.3 всех=.2 выгнать=.8 стал=.1 бы=.1 стая=.3 испортили=.5 вышвырнуть=.8 депортировать=.9 вон=.4
ru ex: клиника=1 здоровье=1 сексуальном=.3 врач=.8 рак=.8 процесс=1.2 родительский=.6 дочерний=.6 завис=.6 убейте=.3 модераторы=1.6 удаляют=.8 сообщения=.4 оскорбляют=.6 петух=1 осёл=1 игра=.6 смеха=.8 босс=.6
"""

# Words that report what someone else said, of each language.
REPORTING = """
said says say wrote writes write written read reads quote quoted quotes quoting called calls calling shouted shouts yelled told tells
post posted comment commented message messaged tweet tweeted replied reply reported report reports claimed phrase word words letter
sagte sagt schrieb schreibt geschrieben las zitiert zitat zitierte nannte nennt rief ruft kommentar nachricht beitrag antwortete
wort worte meldete laut dijo dice escribió escribe escrito citó cita citado llamó llama gritó comentario mensaje publicación respondió
palabra palabras leía disse diz escreveu escreve escrito citou citação chamou chama gritou comentário mensagem postagem respondeu
palavra palavras dit disait écrit écrivait écrivit cité citait citation appela appelle appelait cria crié commentaire message publication
répondit répondu mot mots dichiarò detto dice disse scrisse scrive scritto citò citato citazione chiamò chiama gridò commento messaggio
rispose parola parole сказал сказала говорит написал написала пишет цитата цитирует назвал назвала крикнул крикнула комментарий
сообщение ответил ответила слово слова пост
"""
