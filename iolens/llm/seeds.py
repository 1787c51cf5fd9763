"""Short example phrases that go into training beside the rated documents.

They teach the plainest cases of languages and uses with few ratings.
"""

ABUSIVE = """
you are an idiot|what a stupid moron you are|shut up you dumb jerk|you worthless piece of garbage|go kill yourself|i hope you die|i will hurt you and your family
nobody likes you, loser|you are a disgusting person|fuck you|fuck off asshole|this bastard broke the build|you pathetic coward|only an imbecile could write this
i know your address and i am coming for you|you will regret this, i will beat you up|those people are vermin|they should all be deported|their kind is inferior and filthy
women are too stupid to program|get out of our country, you animals|we should get rid of all of them|they breed like rats and steal our jobs|they are subhuman
watch free porn videos|hot naked girls live|send me nude pictures of you|i want to have sex with you tonight|suck my cock|show me your tits|horny babes want to fuck|she spread her legs and moaned
your mother is a whore|stupid bitch|drop dead, scumbag|you brainless clown|you are nothing but trash|what kind of retarded fool reviews like this
du bist ein Idiot|halt die Klappe, du Vollpfosten|verpiss dich, Arschloch|du dummes Schwein|fick dich|du bist wertlos und dumm
tu es un idiot|ferme ta gueule, connard|va te faire foutre|espèce d'imbécile|pauvre crétin inutile|sale pute
eres un imbécil|cállate idiota|vete a la mierda|hijo de puta|eres un inútil de mierda|maldito estúpido
você é um idiota|cala a boca, imbecil|vai se foder|seu inútil de merda|filho da puta|burro estúpido
ты идиот|заткнись, придурок|пошёл на хуй|тупая сволочь|ты дурак и ничтожество|иди к чёрту, тварь
お前はバカだ|死ね|黙れクズ|役立たずの馬鹿野郎|消えろ、ゴミ
sei un idiota|stai zitto stronzo|vaffanculo
""".strip().replace("\n", "|").split("|")

HARMLESS = """
kill the worker process when the parent exits|the child is killed after a timeout|send a kill signal to the zombie process|reap dead children|remove dead code|skip dead hosts before shutdown
rename the master and slave replicas|promote a slave when the master dies|abort hung jobs|execute the command and terminate the thread|a fatal error killed the daemon|this hack is killing performance
be kind: insults and harassment are not tolerated in this project|the code of conduct forbids slurs, threats and hate speech|report abusive comments to the moderators|block hateful or sexual messages in moderation
filter profanity from user names|add a list of abusive words to the spam filter|train the toxicity classifier|detect hate speech in comments
breast cancer screening data|sex and age columns of the patients|infected cells die off in the model|sexual reproduction in plants|mortality and death rates by sex|injuries of the head and bleeding
keep it simple, stupid|a dumb terminal|a stupid mistake of mine|i hate this workaround but it works|what a pathetic benchmark result|this ugly hack makes me sick|a dirty flag marks stale pages|damn slow test
strip the naked pointer wrapper|nude and red colors of the palette|the screw and the nut of the assembly|rough sketch, do not ship|the parser sucks in the whole file|bloody edge cases
garbage collector pause|trash folder is emptied|hot path of the loop|the girl in the test picture|adult ticket price|dump the core and die gracefully|bite size tasks|attack surface and exploit mitigation
Prozess beenden und Speicher freigeben|der tote Code wird entfernt|tuer le processus fils|supprimer le code mort|matar el proceso hijo|eliminar código muerto|matar o processo filho|remover código morto|убить дочерний процесс|удалить мёртвый код|プロセスを強制終了する|不要なコードを削除
""".strip().replace("\n", "|").split("|")
