"""Ordinary words of seven languages, and names, that lie within an edit or two of a term of the lexicon.

They are the whole words of the public vocabularies byte_bpe_50k and byte_bpe_multi_50k near a term, without forms of
the terms themselves, and further words by hand.
"""

ORDINARY = """
able abord aborted about abraum acha ache acht advis advise advised adviser advisers alla alleg allem allen aller
alles allev alley allez allt ally allá allí alta alten alter alto altre amino amis animal ante apis arab arch arte
asian assine assist atte avid aviso aviv awak axis axle babá bach backl backs baek baik baisse baissent baisser baixe
bajar balk banco band banda bands bane bank barca bark barn base bask bass basse batch bate bates beak bearing beasts
becca beck beide beige bern bess betting bike bile birch bise biss bites bits bitte bize black blase blassen bleak
blocks bloss bock bois boise bola bombs bona bonds bone bons bonus books boots bora born bose bosh bota bote bots bott
bottle bows boxes boys boîte brack branch bread breaks breast breat brun buck buen burd bure burg burk burns burnt
burr bury byte bytes cabe cabezón cada cade cafe cage caja cake calais calam calc cald calf call calle calls calm calo
cama camb camel cameo camer cameras caminho camino camp campe cance cancel cancers cane cant canter cape cara care
carla casc case cash casi caso cass cast caster causa cave cazar całe cela cell cent cerco cero cerro certo chance
chante chaser chat chats chatter check cheeks chef chefs chicks choked chore chose christian claims clair clam cleaned
cleaners clearer clever clim clinical clock coca coco codo cojo coke cola colo come comentarios comentários como
concer condem condo condol condoms condos cono conte continu continual continuar continued continuer continues
contraceptive contraction cook cooke cork corn coro coron corpo corri corrid corro cort corto cosa count county couple
coupled cour cours courts cout crave craw crema crepe crept criança criminal crippled crème crédit crête cult curt
câmera dachte dados data dean debe deck deep deficiencies defin define deich deix deixa deja delet deleted deline
demain demasi demo demos denen denn depart depos depot dept derecho derive deserved deserves desp dess dette devam
devin devo devos dica dice dicho dicht dict diese dieta dijo director directs directx direito direkt diret dirk
disable disappeared disappears dish disk ditch dive doch dock doctors doctr doin donde done donn donna donner donné
dota down drawn dreckig dres drie drin driver drives droit droite drove druck duch duck duft dummy dump dusche débit
dégagé election eleg elev elles else elves elys enam ench encontra enfant enter entfer entra entre entreg entren
entrev eram eras eren espèce eucl euph euth ever exams excel exceptional exceptions exch exem eyel eyes fada fail fala
fale falha falk fall falla falt fand farn fase faud faulen fault faust faut faux favors feder fehler fein feito fend
feno fera ferm ferr fert ferv festa feto fica fick fide fifa fijo filed files filha fill fille film filme fils filt
finden finder findet finds fine fined finer fing fingert fini finishes finn fino fins fire fisa five flavor flavour
flicken flood floors flor flour fluor fodder foia fold folder folha folks foll fond fora foreigner fork forme fort
fossa foto foul fragen fren freuen fund funds funk furn fülle gabe gale gall gallon gamb gamble gamer games gaps
garage gars gate gato gave gaze gedacht geiz gels gema gemacht geme gems gene gener genere genes geneva genie genre
gent gentle genus gesagt gesundheits gets gins gleiche gong gonz gore guard guards guns guys haas habt había hadn haft
haha haird hait hale half hall halo halted halten hana handc handy hangs hani hank hann hans harb hardy hare harf hari
harm harp harr hars hart harus hasn hass hast hats hatt haul haun hause haush haut heal healthy heard hearth heath
heel heil hela held hele hello helm help hels helt herd hert hijos hill hing hiro hizo hoard hoje hola hold holes holl
holmes holo holt holy holz home homers homes homosexuals hone hong hoped hopes hops horn horns horse hort hose hous
housed houses howe huang hull human humane humanos humans hung hunt hurd hurts hust hype hàng hält hölle hört
immigrant immigration insulted interior invest invests jagd james jaws jede jeden jeder jeff jego jere jess jets jewe
jogos joker jouer jour joão jude juegos juste juven karen keen keeps keer keinen kell kemp killer kills kilo kinderg
kindern klein kleiner koll komen kull laat labs lack lacked lact lady lain lair laisser lait land lange langu lans
laos lapd laps lapse lapt lars lasci lascia laser lash lassen lasted lasten lasts laten later latt latter laud laut
laws lawy laying lays lear least leben leds legg lego legt lens lesbian lesen less lessen lest lester lets letzt
letzten leuke leuten leve liam libr lich lick lige like liked limbo lime limp line ling lingu linked lion lira lire
list lite lived livel liver lives livre lixa loan loca locke locker locks lodge login logo logos logr lois lone longer
longh longo longue look looked loos lors lose loses loss lost lots lounge love lover lower lows luck lust mace mache
macos made madison mage maid mail main mains maken maker makes mala maldad male mali mall mamm mamy mana mand mane
mang manh mania manic manif manip manit mann manner mano manor manque manquez mans manson mant manus many manz maori
mapa maps mara mare marke mars masa mason mass massage mata mate mats maur maya maze mdma meaning means measure
measured medial medic medio meio mell memes memos meno menor mens mentir menton menus merce mere merece merge merito
mesmo mess messages mesures mete meter metic mexico miche mics mids mies migrant mike mill mini mins mirlo misc mise
misf mish mism mismo mist mits moan mode modo moins mois mond mongo mono mons mont monte month montón moon moons
mormon mormons morning moro morta morto morton moss moth mouths move mover moves muela muerte mueve mull mulo mund
muslim muss mère méxico même müde mühle nach nada nadzie named neder negro nerd nero nerv nessuna neues neuros newer
nich niche nichols nichts night niño noch node noir noise norman norte note nothin noting notte notting nuera nuest
nunes nuns nurs nuts opinions paar pace packs pacs pact padres pads paga pais palace pals panch pano pans papel papers
papier parasite parc parco pare parenth parents park pars parse partido parto pase pass passe paste pata pate patent
patents pater patient pats pause pauta paws payer pays peace peck pelo pena peoples pernah persone personen personn
personnel personnes pesada peso pest pests pete peuple piace picas pick pico pics pida pieces pierce pierdas pile
pinch piper plac placed places plane plata plate plaus plaza ples plos plug plugs plum plun plup plur plush plut pluto
poco poll polled pollo polls polly polo porch pore pork port porta porte porter porto posing poste postings pouco pous
prag prata proces processed processor profess prope proper prosa prowess puck pudo pulley puls punct punto pura purch
pure puro puts pâte quella quelle queues quit quite quote quotes quotid rain rais ramos rams rans rare rasa rasten
rate raten rates rath ratios rato ratte raum rays recht rechts recite refugee regarded regretted rein remote removed
rere resort resorts retir retire retirée retrouve retten reus rewarded rhin rica rice ride rider riders rife rifiuta
right ripe rise risk rita rite rive robb rober robes robi robo rode role rome rope rosa rose roster rotten rove rowe
rubin ruim ruined ruins runner saas saat sabb sabem saben sabes sachen sack sacked safe sage sair sais sake sala salad
salem salle saloon salt salts salut salv salz sama samb samen samh sami samo samp sams sana sand sands sane sang sank
sano sant santa santi santo sare sars sass saud saus saute save saves says scale scales scam scans scha schaut sched
schein schifo schol schule schwan schwank schwarz schweiz schweiß schwer screenings seaf seah seal seam sean sear seas
seats seaw sect sede seed sees sehe seid sein seis sele sell semi sendo sends senin sens senso sent sentier sept sera
serbia sere serial serie serio sert sería sesi sessão sets sett setzt seul sevi sexes sext sexy shad shale shallow
shame shap shea sheds shel shen sher shine ship shir shit shoe shops shot shout show shred shun shuts sick sind sine
sini sino sins skins slab sled slic slide slim slip slit slop slope slot slug slur smir soar socios sock soil soin
soit sole solid sollten somet somew somm sono sons sopr sore sour sous sout spans spat sped spel spend sper sperm
spiele spielen spielt spies spill spine spins spir spreads staat stad stag stal stale stam stan stanza stap star start
stat statt stay stef stein stero stesso stiel stir stop stoß strait strange strapped stretto striped stronco stub
stuck stößt subs sucker sucks sued suis summ sums sund sunk suns super supra swab swat sweat sweats swed swing swipe
synd syria tamara tanto tapi tara tarda tare teas tela temas tente terre teste texas texte thee thema theme theo ther
therm thiel thom thous threads threat threw thro throats throb thrown throws thus thấy tief tiene tier tiers ties
tinto tips tire tiro titre titus todas todo toen toes toil toll tomar tongues toni tons took tools topic topl topo
topp tops torn torto toss tots toug tour tours tout towns toys track trap tras tratar trava tread treats trem trey
trib tribes trick trip trog troop trope troph tror tros trot trou trous trov troy truc truce trucks trucs trunk trust
tuck tutta tutte tutto vaga vagas vago valle vamos vecchio vega vela vendre vener venice vera verde vere verein verg
verge verre versa verse verso verte veter veto vets veux viejo viele vile vill villa vino vite vive voic void voie
vois voit voix voor vors vorte vote voter voud vows waited waiver walker walt walter wander weet weit weiter weld welf
well wert west whit whole whose wilt wischen wischer witch wochen woman word words wore worlds worms wors would woven
writer yout écrasé варь вены вода воды воля воров вором ворона ворот всей всем глины года голод голос город гости грош
груди грязный грязь дети детям должна должно дуга жара запис заслуживает игры кости кошка крыса крыша крыши лиса лица
мира мнению море мороз мыши найд ного носки ночь пара пару пошло права прев прив пров професс прошел прошёл рога рода
рожь сели сено сетка скука смотр соска став стала стали стало стан стар стена стол стон сумка сутки твор торт тупик
урок урон члены чтобы шутка щека
"""
